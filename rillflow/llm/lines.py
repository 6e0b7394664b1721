"""Repeated line runs, found on a suffix array over line ids and deleted but for their first copy. DataFrame functions only.

Lines without words are left out of the sequences, since they repeat everywhere. Every other line has a place, a number
that grows with doc_id and line, and one more than that of the line before it in its document.

1. Prefix doubling. A suffix's rank is the sorted place of its first line's digest; then of the pair (own rank, rank of
   the suffix `width` lines on), for widths 1, 2, 4, ... until no two suffixes tie. Suffixes that tie with none leave at
   once. Suffixes that tie at a width are a longest-common-prefix interval of at least that many lines; each interval
   knows its first place. A suffix ends with its document, so widths end with the longest repeat.
2. Longest common prefixes. The highest width at which a suffix ties with an earlier one has half of the bits of its
   longest previous copy. The others come from the top down: an interval is split by the rank of what follows, at half
   the width each time; a suffix whose part has an earlier member moves into it, the others stay, with one member of
   each part, so that no step has more than twice as many rows as there are suffixes.
3. A suffix whose copy ends beyond that of the suffix before it begins a maximal repeated run, of known length and first
   place. Runs that count are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, drop, join_groups, parted

MIN_LINES, MIN_WORDS = 4, 50
# words are runs of anything but these
GAPS = " \\t\\r"


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("_doc", F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), text))))


def _has_words(line: Column) -> Column:
    return F.regexp_like(line, F.lit(f"[^{GAPS}]"))


def numbered_lines(keyed: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """doc_id, _doc, at (number of lines with words before it), line (its number in the text), digest, least and pos (the place).

    least is the fewest lines from here on that make a run that counts. Rows that repeat doc_id and text are one document.
    """
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    worded = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("line"), x.alias("x"))), lambda s: _has_words(s["x"]))
    count = lambda x: F.regexp_count(x, F.lit(f"[^{GAPS}]+"))
    each = F.transform(worded, lambda s: F.struct(s["line"].alias("line"), F.unhex(F.md5(s["x"])).alias("digest"), count(s["x"]).alias("words")))

    def least(array: Column, i: Column) -> Column:
        words, enough = [F.coalesce(F.get(array, i + n)["words"], F.lit(0)) for n in range(min_lines - 1)], F.lit(min_lines)
        for n in range(min_lines - 1, 0, -1):
            enough = F.when(sum(words[1:n], words[0]) >= min_words, n).otherwise(enough)
        return enough

    # the one-member array gives the lines a name, so that they are made once for a text
    row = lambda a, x, i: F.struct(i.alias("at"), x["line"].alias("line"), x["digest"].alias("digest"), least(a, i).alias("least"))
    rows = F.flatten(F.transform(F.array(each), lambda a: F.transform(a, lambda x, i: row(a, x, i))))
    raw = cut(keyed.select("doc_id", "_doc", F.inline(rows)))
    # a document is in one range, so the numbers of its lines follow each other
    ordered = raw.repartitionByRange("doc_id", "_doc").distinct().sortWithinPartitions("doc_id", "_doc", "at")
    numbered = cut(ordered.withColumn("pos", F.monotonically_increasing_id()))
    drop(raw)
    return numbered


def _ranked(groups: DataFrame, *by: str) -> DataFrame:
    """An order-preserving number for each row of groups, whose keys are distinct; range-sorted over all partitions.

    The keys differ, so a partition that is made again has the same order and numbers.
    """
    return groups.orderBy(*by).withColumn("rank", F.monotonically_increasing_id())


def _earlier(width: Column | int) -> Column:
    """Whether the copy at `first` is before pos and ends before it, or lies in another document."""
    return (F.col("first") < F.col("pos")) & ((F.col("first") < F.col("start")) | (F.col("pos") - F.col("first") >= width))


def suffix_levels(numbered: DataFrame) -> list[DataFrame]:
    """For widths 1, 2, 4, ...: pos, start (place of the document's first line), least, rank and first of suffixes that tie there."""
    tied = numbered.groupBy("digest").agg(F.count("*").alias("n"), F.min("pos").alias("first")).where("n > 1")
    start = (F.col("pos") - F.col("at")).alias("start")
    levels = [cut(numbered.join(_ranked(tied, "digest"), "digest").select("pos", start, "least", "rank", "first"))]
    while levels[-1].limit(1).count():
        width, own = 1 << (len(levels) - 1), levels[-1]
        ahead = own.select((F.col("pos") - width).alias("pos"), "start", F.col("rank").alias("next"))
        pairs = own.join(ahead, ["pos", "start"]).select("pos", "start", "least", F.col("rank").alias("own"), "next")
        tied = pairs.groupBy("own", "next").agg(F.count("*").alias("n"), F.min("pos").alias("first")).where("n > 1")
        levels.append(cut(pairs.join(_ranked(tied, "own", "next"), ["own", "next"]).select("pos", "start", "least", "rank", "first")))
    drop(levels.pop())
    return levels


def longest_previous(levels: list[DataFrame]) -> tuple[DataFrame | None, list[DataFrame]]:
    """pos, start, least, width, first: the longest copy of what begins at pos that ends before it or is in an earlier document.

    None without any repeat. A row of `rows` is a suffix in the interval of `width` whose first place is `first`; asks says
    that it looks for its own copy, the others are there to be found. Levels above the second are dropped on the way; the other tables that the
    result reads are the second value.
    """
    rows, spent = None, []
    for k in range(len(levels) - 1, -1, -1):
        width = 1 << k
        mine = levels[k]
        if k + 1 < len(levels):
            mine = mine.join(levels[k + 1].where(_earlier(2 * width)).select("pos"), "pos", "left_anti")
        mine = mine.select("pos", "start", "least", F.lit(width).alias("width"), "first", _earlier(width).alias("asks"))
        rows = mine if rows is None else rows.unionByName(mine)
        if k == 0:
            break
        step = width // 2  # rows here have a width of `width` or more, and step is the bit to be found
        after = levels[k - 1].select(F.col("pos").alias("_at"), F.col("start").alias("_start"), F.col("rank").alias("_next"))
        met = rows.withColumn("_at", F.col("pos") + F.col("width")).join(after, "_at", "left")
        met = met.select(*rows.columns, F.when(F.col("_start") == F.col("start"), F.col("_next")).alias("next"))
        parts = met.where("next is not null").groupBy("width", "first", "next").agg(F.count("*").alias("_n"), F.min("pos").alias("_part"), F.max("asks").alias("_asked"))
        split = join_groups(met, parts.where("_n > 1").drop("_n"), ["width", "first", "next"], F.col("pos"), "left")
        found = (F.col("_part") < F.col("pos")) & ((F.col("_part") < F.col("start")) | (F.col("pos") - F.col("_part") >= F.col("width") + step))
        moves = F.col("asks") & F.coalesce(found, F.lit(False))
        inside = F.struct((F.col("width") + step).alias("width"), F.col("_part").alias("first"), moves.alias("asks"))
        stays = F.struct("width", "first", "asks")
        both = F.array(F.when(F.col("_asked"), inside), F.when(~moves & (F.col("asks") | F.col("_part").isNull() | (F.col("pos") == F.col("_part"))), stays))
        finer = cut(split.select("pos", "start", "least", F.inline(F.array_compact(both))))
        drop(*spent, *levels[k + 1 : k + 2])
        rows, spent = finer, [finer]
    return (None if rows is None else rows.where("asks").select("pos", "start", "least", "width", "first")), [*spent, *levels[:2]]


def maximal_runs(keyed: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """_doc, at, lines, first_doc, first_line: runs that count and whose copy begins after an equal one, none inside another.

    at and lines are in lines with words; first_line is the first copy's line in the text of first_doc.
    """
    numbered = numbered_lines(keyed, min_lines, min_words)
    found, spent = longest_previous(suffix_levels(numbered))
    if found is None:
        return numbered.where("false").select("_doc", "at", F.lit(0).alias("lines"), F.col("doc_id").alias("first_doc"), F.col("line").alias("first_line"))
    end = F.col("pos") + F.col("width")
    before = F.lag(end).over(Window.partitionBy("start").orderBy("pos"))
    runs = found.where("width >= least").withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") < end))
    runs = cut(runs.select("pos", "first", F.col("width").alias("lines")))
    drop(*spent)
    named = runs.join(numbered.select("pos", "_doc", "at"), "pos")
    named = named.join(numbered.select(F.col("pos").alias("first"), F.col("doc_id").alias("first_doc"), F.col("line").alias("first_line")), "first")
    named = cut(named.select("_doc", "at", "lines", "first_doc", "first_line"))
    drop(numbered, runs)
    return named


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text, row (the whole input row), line_runs, copies and kept_text.

    A run counts if it has min_lines lines with words, or min_words words. Order is by doc_id (nulls first), then by the
    digest of doc_id and text, then by line. Of a run's copies all but the first go, with the lines without words inside them; a copy is deleted only if an
    earlier one ends before it begins (of a line twelve times over, min_lines stay). line_runs are start and lines
    of each stretch of the text that goes; copies are the maximal runs behind them, which may overlap: line, lines
    (with words), first_doc and first_line, where the first copy begins.
    Null text counts as empty and stays null. Rows that repeat doc_id and text are one document and get the same
    result. Other columns, whatever their names, are in row alone. A text of any length is split into rows of lines; only
    its kept_text is put together by one task. Texts are shuffled only if they have runs, or share a bit of a filter with one that has.
    """
    keyed = _keyed(docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns]).alias("row")))
    runs = maximal_runs(keyed.drop("row"), min_lines, min_words)
    by_doc = runs.groupBy("_doc").agg(F.array_sort(F.collect_list(F.struct("at", "lines", "first_doc", "first_line"))).alias("_runs"))
    # texts without runs stay where they are
    may, without = parted(keyed, runs, "_doc")
    met = may.join(by_doc, "_doc", "left").unionByName(without, allowMissingColumns=True)
    lines = F.split("text", "\n", -1)
    worded = F.filter(F.transform(lines, lambda x, i: F.when(_has_words(x), i)), lambda i: i.isNotNull())
    line = lambda at: F.get(F.col("_worded"), at)
    met = met.withColumn("_worded", F.when(F.col("_runs").isNotNull(), worded))

    def piece(run: Column, i: Column) -> Column:
        """Numbers of the lines of a run, from behind the run before it where the two overlap: runs' ends rise with their starts."""
        last = F.when(i > 0, F.get("_runs", i - 1))
        end = last["at"] + last["lines"]
        behind = F.when(end > run["at"], line(end - 1) + 1)
        return F.sequence(F.greatest(line(run["at"]), behind), line(run["at"] + run["lines"] - 1))

    gone = F.flatten(F.transform("_runs", piece))
    met = met.withColumn("_gone", F.coalesce(gone, F.array().cast("array<int>"))).withColumn("_split", F.when(F.size("_gone") > 0, lines))
    next_ = F.transform("_gone", lambda p: p + 1)
    stretches = F.zip_with(
        F.array_sort(F.array_except("_gone", next_)), F.array_sort(F.array_except(next_, "_gone")), lambda s, e: F.struct(s.alias("start"), (e - s).alias("lines"))
    )
    copies = F.transform("_runs", lambda r: F.struct(line(r["at"]).alias("line"), *(r[c].alias(c) for c in ("lines", "first_doc", "first_line"))))
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("_split") - 1), "_gone"), lambda i: F.get(F.col("_split"), i)), "\n")
    result = F.struct(
        stretches.alias("line_runs"), F.coalesce(copies, F.array().cast(copies_type(docs))).alias("copies"),
        F.when(F.size("_gone") == 0, F.col("text")).otherwise(kept).alias("kept_text"),
    )
    # generated, so that a caller's filter is not moved below and the result not made once for each use of it
    return met.select("doc_id", "text", "row", F.inline(F.array(result)))


def copies_type(docs: DataFrame) -> str:
    return f"array<struct<line:int,lines:int,first_doc:{dict(docs.dtypes)['doc_id']},first_line:int>>"
