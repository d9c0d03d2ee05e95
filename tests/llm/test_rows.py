import random

import numpy as np
import pytest

from lodeline.llm import mixing, topn, truncation

RESULTS = "qid bigint, vec_id bigint, score double, received_at timestamp"


def test_top_n_against_sorting(spark):
    rnd = random.Random(5)
    rows = []
    for q, n in ((1, 3000), (2, 3), (3, 40), (4, 10), (5, 500)):
        for v in range(n):
            s = 0.5 if q == 5 else rnd.choice([rnd.random(), round(rnd.random(), 1), -rnd.random() * 1e-300, 0.0, -0.0, float("inf"), -float("inf"), 1e300])
            rows.append((q, v, s))
    d = spark.createDataFrame(rows, "qid bigint, vec_id bigint, score double").selectExpr("*", "1 AS c", "0 AS lo", "'x' AS need")
    for n in (1, 10, 37):
        want = set()
        for q in range(1, 6):
            own = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))
            want |= {(q, v) for _, v, _ in own[:n]}
        assert {(r.qid, r.vec_id) for r in topn.top_n(d, n).collect()} == want
    assert topn.top_n(d, 0).count() == 0 and topn.top_n(d.limit(0), 5).count() == 0


def test_valid_items(spark):
    nan = float("nan")
    rows = [(1, 1, 0.5, 1), (1, 1, 0.1, 2), (1, 2, 0.5, 1), (1, 2, None, 2), (1, 3, nan, 3), (1, 4, 0.4, None), (1, 4, 0.3, 1), (None, 1, 0.5, 1), (1, None, 0.5, 1), (2, 1, 0.7, 1), (2, 1, 0.7, 1)]
    d = spark.createDataFrame(rows, "qid bigint, vec_id bigint, score double, t bigint").selectExpr("qid", "vec_id", "score", "timestamp_seconds(t) AS received_at", "1 AS r")
    assert sorted(map(tuple, topn.valid_items(d).collect())) == [(1, 1, 0.1), (1, 4, 0.3), (2, 1, 0.7)]


def test_quotas_are_exact():
    rng = np.random.default_rng(0)
    q = np.array([100, 0, 7, 1000])
    s = mixing.split_quotas(q, 13, rng)
    assert (s.sum(0) == q).all() and s.sum(1).max() - s.sum(1).min() <= 1 and (s >= 0).all()
    assert mixing.split_quotas(np.array([], int), 3, rng).shape == (3, 0)


DOCS = "doc_id bigint, text string, source string"
TARGETS = "mix_id int, size_ratio double, source string, weight double, max_repeats int"


def mix(spark, docs, targets, **kw):
    return mixing.plan_mixtures(spark.createDataFrame(docs, DOCS).selectExpr("*", "'b' AS block", "0 AS n_tokens"), spark.createDataFrame(targets, TARGETS), **kw)


def test_mixture(spark):
    docs = [(i, "one two three four five", "A" if i % 4 else " b ") for i in range(2000)] + [(9001, None, None), (9002, "", "a")]
    m = mix(spark, docs, [(1, 0.5, "a", 3.0, 1), (1, 0.5, " B", 1.0, 1), (2, 1.0, "b", 1.0, 2), (2, 1.0, "a", None, 2), (3, 2.0, "none", 1.0, 5), (3, 2.0, "b", 1.0, 5), (4, 1.0, "a", float("nan"), 1)], shards=4)
    r = {(x.mix_id, x.source): x for x in m.report.collect()}
    assert set(r) == {(1, "a"), (1, "b"), (2, "b"), (3, "none"), (3, "b")}
    total = 10000
    assert r[1, "a"].source_tokens == 7500 and r[1, "a"].target_tokens == total * 0.375 and abs(r[1, "a"].actual_tokens - r[1, "a"].target_tokens) <= 25 and not r[1, "a"].short
    assert r[2, "b"].short and r[2, "b"].actual_tokens == 5000 and r[2, "b"].actual_share == 1.0
    assert r[3, "none"].short and r[3, "none"].actual_tokens == 0 and not r[3, "b"].short and r[3, "b"].actual_tokens == 10000
    drawn = mixing.drawn_records(m).collect()
    for x in m.report.collect():
        assert x.actual_tokens == sum(r.n_tokens for r in drawn if (r.mix_id, r.source) == (x.mix_id, x.source))
    for k, x in r.items():
        own = [y for y in drawn if (y.mix_id, y.source) == k]
        assert sum(y.n_tokens for y in own) == x.actual_tokens
        assert len({(y.doc_id, y.copy) for y in own}) == len(own) and all(y.copy < 5 for y in own)
    shards = {}
    for y in drawn:
        shards.setdefault((y.mix_id, y.shard), []).append(y.pos)
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in shards.values())


def test_mixture_of_nothing(spark):
    m = mix(spark, [], [(1, 0.5, "a", 1.0, 1), (1, None, "b", 1.0, None)])
    assert all(x.actual_tokens == 0 for x in m.report.collect()) and mixing.drawn_records(m).count() == 0
    assert mix(spark, [(1, "x", "a")], []).report.count() == 0


COMPLETE = [
    "Heading\n1. The claim was late. The appeal is dismissed.",
    "Heading\n1. The claim was late.\n(signed) A. Corsarn",
    "Heading\n1. The claim was late.\r\nCited: [2002] Ost. Rep. 713; X v Y (1990) 4 T.Z.R. 856\r\n— text supplied by the reporting service —",
    "Heading\n1. The claim was late.\nCorr.: 3 March 2007, 20 pp…",
    "Heading\n1. The claim was late.\nParties: Abba, Bcda and others ...",
    "Heading\n1. Απορρίπτει την έφεση.\nKeldby, 3.4.2010",
    "A v. B — settled",
    "No written reasons",
    "Heading\nHe said \"it's late.\"\n[End of decision]\n- 3 -",
]
CUT = [
    "Heading\n1. The claim was late. The appeal on that gro",
    "Heading\n1. The claim was late. By a notice dated 3 March the court h...",
    "Heading\n1. The claim was late. The sum of 42,000",
    "Heading\n1. The claim was late. In Xard v Yard (1967) 3 Ost.",
    "Heading\n1. The claim was late. Nev\n[1 file attached]",
    "Heading\n1. The claim was late, although the bo [more]",
    "Heading\n1. Die Klage war sp�",
    "Heading\n1. The claim was late.\n12.",
]


def test_endings(spark):
    rows = [(i, t) for i, t in enumerate(COMPLETE)] + [(100 + i, t) for i, t in enumerate(CUT)] + [(200, None), (201, ""), (202, " \n "), (203, "- 2 -")]
    d = spark.createDataFrame([(i, t, None if i % 3 else " S ") for i, t in rows], DOCS).selectExpr("*", "1 AS cut", "'x' AS skeleton")
    assert sorted(r.doc_id for r in truncation.truncated(d).collect()) == [100 + i for i in range(len(CUT))]
    assert truncation.truncated(d.limit(0)).count() == 0


def test_endings_of_another_corpus(spark):
    """Closing lines in words that are in no list; body lines of the same corpus open as its cut ones do."""
    last = ["By order of the court", "So ordered by the full bench", "Per curiam", "Clerk of the Court", "Dated this third day of May", "Der Vorsitzende Richter", "Registrar in chambers", "Note: 4 exhibits", "Witnessed by Q. Abcdef"]
    body = ["The harbour master had not given the ship any notice of the new tariff.", "On the facts the pilot was bound by what the owner had told him.", "Mangels einer Frist war der Antrag des Reeders in jedem Fall noch zulässig."]
    cut = ["The harbour master had not gi", "On the facts the pilot", "Mangels einer Frist w"]
    rows = [(i, "In re Q\n" + "\n".join(body) + "\n" + x) for i, x in enumerate(last)] + [(50, "In re Q\n" + "\n".join(body))] + [(100 + i, "In re Q\n" + body[i] + "\n" + x) for i, x in enumerate(cut)]
    d = spark.createDataFrame([(i, t, "s") for i, t in rows], DOCS)
    assert sorted(r.doc_id for r in truncation.truncated(d).collect()) == [100, 101, 102]


def test_hidden_limits(spark):
    rnd = random.Random(1)
    word = lambda n: " ".join(rnd.choice(["lease", "claim", 'a "b"', "é"]) for _ in range(n))
    rows = [(i, word(rnd.randint(60, 300)) + ".", "x") for i in range(300)] + [(1000 + i, (word(200))[:500].ljust(500, "q"), "x") for i in range(20)]
    rows += [(2000 + i, word(300).encode()[:700].decode(errors="ignore").ljust(700)[:700], "y") for i in range(3)]
    docs = spark.createDataFrame(rows, DOCS)
    _, limits = truncation.inspect(docs)
    assert ("x", "characters", 500, 20) in {tuple(r) for r in limits.collect() if r.n >= 20}
    r = {x.source: x for x in truncation.rates(docs).collect()}
    assert r["x"].n == 320 and r["x"].n_at_limit >= 15 and any("500" in x for x in r["x"].limits)


@pytest.mark.parametrize("text, want", [("a&b", {"characters": 3, "bytes": 3, "xml": 7}), ('é"\n', {"characters": 3, "bytes": 4, "json": 5, "line_crlf": 4}), ("a\r\nb😀", {"characters": 5, "utf16": 6, "line_lf": 4, "line_crlf": 5})])
def test_lengths(spark, text, want):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(text,)], "text string").select(*[c.alias(k) for k, c in truncation.lengths(F.col("text")).items()]).first()
    assert {k: d[k] for k in want} == want


def test_half_of_all_items_in_one_group(spark):
    """The heavy group's items aren't shuffled by their group."""
    rows = [(0 if i % 2 else 1 + i % 40, i, float((i * 7919) % 501)) for i in range(4000)]
    d = spark.createDataFrame(rows, "qid bigint, vec_id bigint, score double")
    got = sorted((r.qid, r.vec_id) for r in topn.top_n(d, 10).collect())
    want = []
    for q in {r[0] for r in rows}:
        want += [(q, v) for _, v in sorted((-s, v) for g, v, s in rows if g == q)[:10]]
    assert got == sorted(want)
