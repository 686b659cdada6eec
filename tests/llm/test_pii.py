import hashlib
import random
import re

from pyspark.sql import functions as F

from loomlog.llm import pii
from tests.llm.helpers import AWKWARD, documents

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for k, (name, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = name == "email" or name == "ip" and all(int(p) <= 255 for p in m.group().split(".")) or name == "card" and 12 <= len(digits) <= 19 and pii.luhn(digits) or name == "phone" and 9 <= len(digits) <= 15
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_match_plain_patterns():
    rng = random.Random(9)
    parts = ["a", "Z9", "@", ".", "x.com", "1", "255", "256", "4111 1111 1111 1111", "4111111111111111", "-", " ", "+", "+1 (988) 555-2485", "(", ")", "10.0.0.1", "0001", "é", "%", "_", "\n", "user@mail.example.org"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert pii.base_spans(text) == brute(text), repr(text)
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_long_runs_are_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+" * 100_000, "1 " * 100_000, "x@" * 100_000, "a1" * 100_000, "ab" * 100_000 + "1", "a=" * 100_000 + "1", "A-b_9/" * 50_000):
        pii.mentions(text)


CONTEXT = [(i, f"please reach us by hotline +1 (9{i:02d}) 555-24{i:02d} any weekday, thank you") for i in range(30)]
UNSEEN = [(200, "please reach us by hotline 0911 555-2477 any weekday, thank you"), (201, "part number 0911 555-2477 is in stock")]


def spans_of(spark, rows):
    return {r.doc_id: r.spans for r in pii.find_pii(documents(spark, rows)).select("doc_id", pii.spans_text(F.col("spans")).alias("spans")).collect()}


def test_patterns_discover_unseen_identifiers(spark):
    got = spans_of(spark, CONTEXT + UNSEEN)
    start = UNSEEN[0][1].index("0911")
    assert got[200] == f"phone:{start}:{start + 13}" and got[201] == ""
    assert all(got[i].startswith("phone:") and "," not in got[i] for i, _ in CONTEXT)


def test_half_of_the_identifiers_unseen(spark):
    """Recall of the method on planted identifiers that no base pattern finds, and no span in texts without any."""
    rng = random.Random(1)
    hexed = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f"word{i} call the help desk on {'+1 (9%02d) 555-2%03d' % (i, i) if i % 2 else '09%02d 555-2%03d' % (i, i)} before noon") for i in range(40)]
    rows += [(100 + i, f"the {i} config says API_TOKEN = \"{hexed() if i % 2 else 'k%07dx' % i}\" in it") for i in range(40)]
    rows += [(200 + i, f"build {hexed()} of item 09{i:02d} 555-21{i:02d} shipped") for i in range(20)]
    got = spans_of(spark, rows)
    found = {i: t[int((s := got[i].split(":"))[1]) : int(s[2])] for i, t in rows if got[i]}
    assert len([i for i in found if i < 100]) >= 36 and len([i for i in found if 100 <= i < 200]) >= 36
    assert not [i for i in found if i >= 200 and found[i].startswith("09")]
    assert all(got[i].startswith("secret:") and found[i] in t for i, t in rows[40:80] if i in found)


def test_redact_is_linear_in_spans():
    text = "a@b.cd " * 100_000
    spans = [{"start": 7 * i, "kind": 0, "end": 7 * i + 6} for i in range(100_000)]
    assert pii.cut_out(text, spans) == "[EMAIL] " * 100_000


def test_copies_are_no_support(spark):
    got = spans_of(spark, [(i, CONTEXT[0][1]) for i in range(30)] + UNSEEN)
    assert got[200] == ""


def test_digest_and_edge_cases(spark):
    rows = AWKWARD + [(30, "mail bob@x.org from 10.1.2.3 or +49 30 1234567")]
    found = pii.find_pii(documents(spark, rows))
    got = sorted((r.doc_id or -1, r.s) for r in found.select("doc_id", pii.spans_text(F.col("base")).alias("s")).collect())
    assert got == sorted((i or -1, ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in brute(t or ""))) for i, t in rows)
    assert hashlib.sha256(b"").hexdigest() == found.filter("doc_id = 3").select(F.sha2(pii.spans_text(F.col("base")).cast("binary"), 256)).first()[0]


def test_query_counts_each_kind(spark, tmp_path):
    rows = [(1, "a@b.c c@d.e 10.1.2.3"), (2, "+49 30 1234567"), (3, "4111 1111 1111 1111 f@g.h"), (4, None)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.op10_pii(spark, str(tmp_path)).collect()}
    want = {i: tuple(sum(kind == k for _, kind, _ in brute(t or "")) for k in range(4)) for i, t in rows}
    assert got == want == {1: (2, 1, 0, 0), 2: (0, 0, 0, 1), 3: (1, 0, 1, 0), 4: (0, 0, 0, 0)}


def test_redact(spark):
    docs = documents(spark, [(1, "é bob@x.org 𝒳 10.1.2.3 end"), (1, "é bob@x.org 𝒳 10.1.2.3 end"), (2, None), (3, ""), (None, "+49 30 1234567")])
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.text) for r in out.collect()) == sorted(["é [EMAIL] 𝒳 [IP] end"] * 2 + ["None", "", "[PHONE]"])
    assert pii.redact(documents(spark, [])).count() == 0
