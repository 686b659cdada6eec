import random

from loomlog.llm import simhash
from loomlog.llm.components import components
from tests.llm.helpers import AWKWARD, documents


def brute_components(pairs):
    """pairs: (doc_id, fp); least id reachable over at most two differing bits."""
    out = {}
    todo = set(range(len(pairs)))
    while todo:
        group, front = set(), [todo.pop()]
        while front:
            i = front.pop()
            group.add(i)
            near = {j for j in todo if ((pairs[i][1] ^ pairs[j][1]) & (2**64 - 1)).bit_count() <= 2}
            todo -= near
            front += near
        ids = [pairs[i][0] for i in group if pairs[i][0] is not None]
        out |= {i: min(ids, default=None) for i in group}
    return [(pairs[i][0], out[i]) for i in range(len(pairs))]


def test_fingerprint_by_definition():
    import xxhash

    text = "Ab c  D e\tab c d É"
    words = text.encode().lower().split()
    grams = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(g >> b & 1 for g in grams) > len(grams))
    assert simhash.fingerprint(text) & (2**64 - 1) == want
    assert simhash.fingerprint(" Ab\tC") & (2**64 - 1) == xxhash.xxh64_intdigest(b"ab c", 42)
    assert simhash.fingerprint(" ") == simhash.fingerprint(None) == 0


def test_long_text_in_steps(monkeypatch):
    text = " ".join(f"w{i % 700}" for i in range(3000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "STEP", 100)
    assert simhash.fingerprint(text) == whole


def test_components_match_brute_force(spark):
    rng = random.Random(2)
    base = " ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(99)) for _ in range(400)).split()
    rows = list(AWKWARD)
    for i in range(60):
        words = list(base)
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = "new"
        rows.append((100 + i, " ".join(words)))
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    want = brute_components([(i, simhash.fingerprint(t)) for i, t in rows])
    key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or 0)
    assert sorted(((r.doc_id, r.component_id) for r in got), key=key) == sorted(want, key=key)
    assert len({r.component_id for r in got if (r.doc_id or 0) >= 100}) < 60


def links_of(spark, fps, long_list):
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    return {(r.node, r.label) for r in components(simhash.links(df, long_list)).collect()}


def test_long_lists_give_the_same_components(spark):
    rng = random.Random(7)
    root, fps = rng.getrandbits(64), set()
    for _ in range(40):
        x = root
        for b in rng.sample(range(64), rng.randrange(4)):
            x ^= 1 << b
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(200)}
    assert links_of(spark, sorted(fps), 1) == links_of(spark, sorted(fps), 10**6)
    signed = {simhash._signed(f): f for f in fps}
    want = brute_components([(k, v) for k, v in signed.items()])
    linked = links_of(spark, sorted(fps), 5)
    assert linked == {(n, c) for n, c in want if sum(c == d for _, d in want) > 1}


def test_chain_of_components(spark):
    chain = spark.range(300).selectExpr("id a", "id + 1 b")
    assert {(r.node, r.label) for r in components(chain).collect()} == {(i, 0) for i in range(301)}


def test_one_of_each(spark):
    kept = simhash.one_of_each(documents(spark))
    assert kept.columns == documents(spark).columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 5, 6, 7]
    assert simhash.one_of_each(documents(spark, [])).count() == 0


def test_one_of_each_keeps_different_texts_under_one_id(spark):
    rng = random.Random(4)
    prose = [" ".join(f"{rng.choice('abcdef')}{rng.randrange(10**6)}" for _ in range(60)) for _ in range(8)]
    rows = [(None, prose[0]), (None, prose[1]), (None, prose[2]), (None, prose[2]), (5, prose[3]), (5, prose[4]), (1, prose[4]), (None, prose[5]), (9, prose[5]), (5, None)]
    kept = simhash.one_of_each(documents(spark, rows)).collect()
    assert sorted(((r.doc_id or 0), r.text or "") for r in kept) == sorted([(0, prose[0]), (0, prose[1]), (0, prose[2]), (5, prose[3]), (1, prose[4]), (9, prose[5]), (5, "")])
