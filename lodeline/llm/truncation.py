"""Texts cut off by field limits or broken transfers (problem 8).

Lengths are recomputed as other systems count them (characters, bytes, UTF-16 units, escaped for XML or JSON, with other line ends), and the records of each
source are counted by each of them: a value that holds many more records than its surroundings is a hidden limit of that source. Then
endings are inspected. Trailing lines that a publisher or a page adds are set aside; what ends then with a whole sentence or with a
closing line (signature, seal, date, citation, note) is complete. A closing line is a short line of its own after a whole sentence or another one, without a paragraph's
number, that opens as no paragraph of the corpus does (the first two words of all longer lines, and of short last ones, are counted); or one whose skeleton
(capitalised words and digits made alike) ends a noticeable share of all records; or of a known form. What ends in the middle of a word or sentence, or with a
mark of omission, is cut; at a limit of its source, an ending that would pass as a sentence only by an abbreviation's full stop is too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.llm.mixing import source_key
from lodeline.plans.runtime import materialize

# Forms of trailing lines that are no part of a decision, as regular expressions of a whole line.
PUBLISHER_LINES = (
    r"\[\d+ files? attached\]",
    r"[—–] .* [—–]",
    r"\([cC]\) .*",
    r"©.*",
    r"Downloaded .*",
    r".* retrieved [\d./-]+",
    r"-+ ?\d+ ?-+",
    r"\*\*\* .* \*\*\*",
    r"Page \d+ of \d+",
    r".* · \p{Lu}{3}-\p{Lu}\d\d .*",
)
# Forms of lines that close a decision, as regular expressions of a whole line: a note in brackets, a label of one word and what it names, place and date, a signature.
CLOSING_LINES = (
    r"\[\p{L}[^\]]*\]",
    r"\(\p{L}[^()]*\)",
    r"\p{Lu}[\p{L}.]{1,14} ?: (?:(?! \p{Ll}{4,} \p{Ll}).)*",
    r"\p{Lu}[^,;:]{1,40},(?: \p{L}{1,3})? [\d.]+\d",
    r"(?:\S+ ){0,4}\p{Lu}\. \p{Lu}\S+(?:, .*)?",
)
# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ("Ost", "Rep", "Keld", "Civ", "Morv", "App", "para", "vgl", "voir", "Nr", "No", "Art", "art", "S", "p", "pp", "v", "c", "gez", "Corr", "Abs", "Rn")

#: A record of one line below this many characters is a notice.
NOTICE = 80
#: A limit holds at least so many records of its source, and this many times what the lengths around it hold.
LEAST_AT_LIMIT, TIMES = 5, 10.0
AROUND = 64
#: Words of a line beyond which it is no closing line of its own; characters beyond which it is a paragraph of the decision.
SHORT, LONG = 8, 60
# Fixed value: the number before a paragraph.
_NUMBER = r"^(?:\p{L}{1,4}\.? ?)?[\[(§]* ?\d+[\])]?[.)]? +(?=[\p{L}\[(])"
#: A skeleton that ends this share of all records (and LEAST_AT_LIMIT of them) is a closing line.
CLOSING_SHARE = 0.001


def _count(text: Column, what: str) -> Column:
    """How often a string of one symbol or more occurs."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)).cast("long")


def lengths(text: Column) -> dict[str, Column]:
    """The length of a text as different systems count it."""
    n = F.length(text).cast("long")
    lf, crlf, quote = _count(text, "\n"), _count(text, "\r\n"), _count(text, '"')
    markup = _count(text, "&") * 4 + (_count(text, "<") + _count(text, ">")) * 3
    cr = _count(text, "\r")
    return {
        "characters": n,
        "bytes": F.octet_length(text).cast("long"),
        "utf16": n + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]")),
        "xml": n + markup,
        "xml_quoted": n + markup + quote * 5 + _count(text, "'") * 4,
        "json": n + quote + _count(text, "\\") + lf + cr + _count(text, "\t"),
        "line_lf": n - crlf,
        "line_crlf": n + lf - crlf,
    }


def hidden_limits(measured: DataFrame) -> DataFrame:
    """``source, measure, length, n``: lengths that hold far more records of a source than those around. measured: ``source, lens`` (map)."""
    c = measured.select("source", F.explode("lens").alias("measure", "length")).groupBy("source", "measure", "length").agg(F.count(F.lit(1)).alias("n"))
    near = F.sum("n").over(Window.partitionBy("source", "measure").orderBy("length").rangeBetween(-AROUND, AROUND))
    c = c.withColumn("around", (near - F.col("n")) / (2.0 * AROUND))
    return c.where((F.col("n") >= LEAST_AT_LIMIT) & (F.col("n") >= TIMES * F.col("around")) & (F.col("length") > NOTICE)).drop("around")


def _any(forms: tuple[str, ...]) -> str:
    return "^(?:" + "|".join(forms) + ")$"


def words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"\S+"))


def opening(line: Column) -> Column:
    """The first two words of a line, without a paragraph's number."""
    return F.regexp_extract(F.regexp_replace(line, _NUMBER, ""), r"^(\S+(?: \S+)?)", 1)


def endings(documents: DataFrame) -> DataFrame:
    """``doc_id, source, lens, last, tail, one_line, before, openings`` (of the longer lines but the last): the last line of each text that no publisher or page added (null if the text is
    null or blank), also with up to two lines before it (for scans that wrap lines)."""
    lines = F.filter(F.transform(F.split(F.col("text"), r"[\r\n\u0085  ]+"), lambda x: F.regexp_replace(x, r"(?U)^[\s ﻿]+|[\s ﻿]+$", "")), lambda x: x != "")
    d = documents.select("doc_id", source_key(F.col("source")).alias("source"), "text").withColumn("lines", lines)
    own = F.array_max(F.transform("lines", lambda x, i: F.when(x.rlike(_any(PUBLISHER_LINES)), F.lit(0)).otherwise(i)))
    d = d.withColumn("at", own + 1)
    lens = F.create_map(*[x for k, c in lengths(F.col("text")).items() for x in (F.lit(k), c)])
    start = F.greatest(F.col("at") - 2, F.lit(1))
    return d.select(
        "doc_id",
        "source",
        F.when(F.col("text").isNotNull(), lens).alias("lens"),
        F.when(F.size("lines") > 0, F.element_at("lines", F.col("at"))).alias("last"),
        F.when(F.size("lines") > 0, F.array_join(F.slice("lines", start, F.col("at") - start + 1), " ")).alias("tail"),
        (F.size("lines") == 1).alias("one_line"),
        F.when(F.col("at") > 1, F.element_at("lines", F.greatest(F.col("at") - 1, F.lit(1)))).alias("before"),
        F.array_distinct(F.transform(F.filter("lines", lambda x, i: (i + 1 != F.col("at")) & (F.length(x) > LONG)), lambda x: opening(F.substring(x, 1, LONG)))).alias("openings"),
    )


def skeleton(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, r"\p{Lu}[\p{L}'’-]*", "W"), r"\d+", "9")


def inspect(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, source, cut, at_limit`` of every row; the hidden limits).

    A null, empty or blank text and a short notice are not cut. Sources are compared in lower case without blanks; a null
    source is a source of its own. Repeated rows and ids stay. documents: ``doc_id, source, text``; other columns don't matter."""
    e = materialize(endings(documents), "endings")
    limits = materialize(hidden_limits(e.where("lens is not null")), "limits")
    # The share of the records that a closing line's skeleton ends, counted once over all sources.
    total = e.count()
    kind = e.where("last is not null").groupBy(skeleton(F.col("last")).alias("skeleton")).agg(F.count(F.lit(1)).alias("n"))
    usual = kind.where((F.col("n") >= max(LEAST_AT_LIMIT, CLOSING_SHARE * total)) & F.col("skeleton").rlike(r"\p{L}") & ~F.col("skeleton").rlike(r"(?:\.\.\.|…|\[more\])$")).select("skeleton", F.lit(True).alias("usual"))
    at = e.select("doc_id", F.col("source").alias("s"), F.explode("lens").alias("m", "len"))
    at = at.join(limits, at["s"].eqNullSafe(limits["source"]) & (at["m"] == limits["measure"]) & (at["len"] == limits["length"])).select("doc_id").distinct().withColumn("at_limit", F.lit(True))
    # An opening is one of paragraphs if it opens longer lines in more records than it opens short last lines.
    longer = e.select(F.explode("openings").alias("opening")).groupBy("opening").agg(F.count(F.lit(1)).alias("n"))
    short = e.where(words(F.col("last")) <= SHORT).groupBy(opening(F.col("last")).alias("opening")).agg(F.count(F.lit(1)).alias("m"))
    body = longer.join(short, "opening", "left").where(F.col("n") > F.coalesce("m", F.lit(0))).select("opening", F.lit(True).alias("body"))
    d = e.drop("openings", "lens").withColumn("skeleton", skeleton(F.col("last"))).withColumn("opening", opening(F.col("last")))
    d = d.join(usual, "skeleton", "left").join(body, "opening", "left").join(at, "doc_id", "left")
    last, at_limit = F.col("last"), F.coalesce("at_limit", F.lit(False))
    wrapped = F.col("tail").rlike(r"(?:^|[.!?)\]] )\p{Lu}\p{L}{2,14} ?: (?:(?! \p{Ll}{4,}).)*$") & ~at_limit
    before = F.col("before")
    after_whole = before.isNull() | before.rlike(r"[.!?;:][\"'”’»)\]]*$") | ((words(before) <= SHORT) & ~before.rlike(_NUMBER))
    own_line = (words(last) <= SHORT) & last.rlike(r"^(?:\p{Lu}|[\[(\"'“«]\p{L})") & ~last.rlike(_NUMBER) & ~last.rlike(r"[-,–]$") & after_whole & F.col("body").isNull() & ~at_limit
    closing = own_line | (last.rlike(_any(CLOSING_LINES)) & ~last.rlike(_NUMBER)) | wrapped | (F.coalesce("usual", F.lit(False)) & ~at_limit)
    omitted = last.rlike(r"(?:\.\.\.|…|\[more\]|\[\.\.\.\]|\[…\]|\(more\)|�)$")
    sentence = last.rlike(r"[.!?;][\"'”’»)\]]*$") & ~last.rlike(r"^[\[(§ ]*\d+[\])]?\.?$")
    short_stop = last.rlike(r"(?<![\p{L}\d])(?:" + "|".join(ABBREVIATIONS) + r"|T\.Z\.R|T\.Z|T)\.$")
    notice = F.col("one_line") & (F.length(last) < NOTICE) & ~omitted
    cut = last.isNotNull() & ~notice & ~closing & (omitted | ~sentence | short_stop)
    return d.select("doc_id", "source", F.coalesce(cut, F.lit(False)).alias("cut"), at_limit.alias("at_limit")), limits


def truncated(documents: DataFrame) -> DataFrame:
    """``doc_id`` of the documents whose text was cut."""
    return inspect(documents)[0].where("cut").select("doc_id").distinct()


def rates(documents: DataFrame) -> DataFrame:
    """``source, n, n_cut, share, n_at_limit, limits``: how often each source cuts, and its limits as measure:length."""
    d, limits = inspect(documents)
    r = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("cut").cast("long")).alias("n_cut"), F.sum((F.col("cut") & F.col("at_limit")).cast("long")).alias("n_at_limit"))
    best = limits.groupBy("source", "length").agg(F.max_by("measure", F.struct("n", "measure")).alias("measure"))
    lim = best.groupBy(F.col("source").alias("s")).agg(F.array_sort(F.collect_set(F.concat_ws(":", "measure", "length"))).alias("limits"))
    r = r.join(lim, F.col("source").eqNullSafe(F.col("s")), "left")
    return r.select("source", "n", "n_cut", F.round(F.col("n_cut") / F.col("n"), 6).alias("share"), "n_at_limit", F.coalesce("limits", F.array().cast("array<string>")).alias("limits"))
