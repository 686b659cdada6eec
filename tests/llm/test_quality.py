import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomlog.llm import quality
from tests.llm.helpers import AWKWARD, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


MORE = [(20, "one two three four five six seven eight nine " * 4), (21, "a b c d e f g h a b c d e f g h z"), (22, "w " * 40 + "<<<>>> ### | $%&*"), (23, "x\nx\nx y\n\n \n x")]


def test_measures_match_brute_force(spark):
    rows = AWKWARD + MORE
    got = quality.quality_verdicts(documents(spark, rows)).collect()
    want = sorted(((-1 if i is None else i), *brute(t)) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)


def test_order_changes_no_verdict(spark):
    docs, rules = documents(spark, AWKWARD + MORE), quality.default_rules()
    measured = quality.measured(docs)
    verdict = lambda rs: sorted(str((r[0], r[1])) for r in measured.select("doc_id", quality.cascade(rs).isNull()).collect())
    assert verdict(rules) == verdict(rules[::-1])


SYMBOLS = " ".join(f"w{i}ord###" for i in range(60))
REPEATS = "one two three four five six seven eight nine " * 9
GOOD = " ".join(f"w{i}ord" for i in range(60))


@pytest.mark.parametrize("texts,first", [(["short"] * 5 + [GOOD], "few_words"), ([SYMBOLS] * 9 + [GOOD], "symbols"), ([REPEATS] * 99 + ["few"], "repeated_words"), ([REPEATS] * 2 + [SYMBOLS], "symbols"), (["x" * 900 + " y" * 30] * 3, "word_length")])
def test_order_puts_rejections_per_cost_first(spark, texts, first):
    docs = documents(spark, list(enumerate(texts)))
    names = [[r.name for r in quality.rule_order(docs, quality.default_rules())] for _ in range(2)]
    assert names[0] == names[1] and names[0][0] == first
    assert sorted(names[0]) == sorted(r.name for r in quality.default_rules())


def test_order_without_rows(spark):
    assert [r.name for r in quality.rule_order(documents(spark, []), quality.default_rules())] == [r.name for r in quality.default_rules()]


def test_later_rules_see_no_rejected_row(spark):
    docs = documents(spark, [(1, "short"), (2, GOOD), (3, None)])
    few = quality.default_rules()[0]
    trap = quality.Rule("trap", ("n_repeat_words",), F.when(F.size(F.array_distinct(F.split("text", " "))) < 20, F.raise_error(F.lit("evaluated"))).otherwise(F.col("n_repeat_words") > 5).cast("boolean"))
    assert [r.doc_id for r in quality.passing(docs, [few, trap], ordered=True).collect()] == [2]
    with pytest.raises(Exception, match="evaluated"):
        quality.passing(docs, [trap, few], ordered=True).collect()


def test_passing_agrees_with_verdicts(spark):
    docs = documents(spark, AWKWARD + MORE + [(50, GOOD), (51, SYMBOLS), (52, REPEATS)])
    want = sorted(str(r.doc_id) for r in quality.quality_verdicts(docs).filter("kept").collect())
    for rules in (None, quality.default_rules()[::-1]):
        assert sorted(str(r.doc_id) for r in quality.passing(docs, rules, ordered=bool(rules)).collect()) == want
    assert quality.passing(docs).columns == docs.columns


def test_plan_filters_between_measures(spark):
    docs = documents(spark, [(1, GOOD)])
    plan = quality.passing(docs, quality.default_rules(), ordered=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Filter") >= 4 and "Python" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("text,kept", [("word " * 5, False), (None, False), (" ".join(f"w{i}ord" for i in range(60)), True), (" ".join(f"w{i}ord###" for i in range(60)), False)])
def test_verdicts(spark, text, kept):
    assert quality.quality_verdicts(documents(spark, [(1, text)])).first().kept is kept


def test_empty_table(spark):
    assert quality.quality_verdicts(documents(spark, [])).count() == 0
