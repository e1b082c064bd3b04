"""Repeated runs of lines, found by rolled hashes of neighbouring lines and removed after byte comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainledger.llm.tables import documents, join_groups, join_sized, keep, let

#: A boundary follows a pair of lines whose rolled hash starts with one of so many of the 16 hex digits.
BOUNDARY_DIGITS = 8
#: A line of so many words is a chunk of its own, wherever it stands; a run of so many words goes whatever its chunks.
LONG_LINE_WORDS = 50
#: Bodies up to this length are compared as they are, longer ones by SHA-256, so that rows carrying them have a bound.
BODY_BYTES = 32 * 1024
#: A short line at the edge of a run is a common one if it stands more than so many times as often as the pair it is in.
COMMON_TIMES = 2
_BLANKS = r"[\x09-\x0D\x20]+"
_STEPS = ("chunks_total", "chunks_removed", "bytes_removed", "emptied", "row_key", "cuts", "rebuilt")


def _words(line: Column) -> Column:
    return F.size(F.filter(F.split(line, _BLANKS), lambda x: x != ""))


def _is_long(line: Column, words: int) -> Column:
    """At least ``words`` words; most lines are told to be short by their length alone."""
    return (F.length(line) >= 2 * words - 1) & (_words(line) >= words)


def _parsed(text: Column, digits: int, long_words: int, body) -> Column:
    """``body(t)`` where t has the arrays lines, longs and ends: whether a chunk ends after each line.

    It does if the hash rolled over the hashes of the line and the one before says so, before and after a long
    line, and at the end of the text: this depends on the lines around alone, wherever they stand.
    """
    edge = F.lit(f"{digits - 1:x}")

    def hashed(lines: Column) -> Column:
        return F.struct(
            lines.alias("lines"),
            F.transform(lines, F.md5).alias("hashes"),
            F.transform(lines, lambda x: _is_long(x, long_words)).alias("longs"),
        )

    def with_ends(t: Column) -> Column:
        def ends(_: Column, i: Column) -> Column:
            rolled = F.md5(F.concat(F.get(t["hashes"], i - 1), F.get(t["hashes"], i)))
            beside = F.get(t["longs"], i) | F.coalesce(F.get(t["longs"], i + 1), F.lit(True))
            return beside | F.coalesce(F.substring(rolled, 1, 1) <= edge, F.lit(False))

        return F.struct(t["lines"].alias("lines"), t["longs"].alias("longs"), F.transform(t["lines"], ends).alias("ends"))

    return let(F.split(text, "\n", -1), lambda lines: let(hashed(lines), lambda t: let(with_ends(t), body)))


def chunks(text: Column, digits: int = BOUNDARY_DIGITS, long_words: int = LONG_LINE_WORDS) -> Column:
    """Array of (pos, first, lines, body): the text cut where chunks end. Joined by line feeds the bodies give it again."""

    def cut(t: Column) -> Column:
        def last_lines(ends: Column) -> Column:
            numbers = F.transform(ends, lambda end, i: F.when(end, i + 1))
            return F.filter(numbers, lambda x: x.isNotNull())

        def chunk(last: Column, k: Column, lasts: Column) -> Column:
            before = F.coalesce(F.get(lasts, k - 1), F.lit(0))
            body = F.array_join(F.slice(t["lines"], before + 1, last - before), "\n")
            return F.struct((k + 1).alias("pos"), (before + 1).alias("first"), (last - before).alias("lines"), body.alias("body"))

        return let(last_lines(t["ends"]), lambda lasts: F.transform(lasts, lambda last, k: chunk(last, k, lasts)))

    return _parsed(text, digits, long_words, cut)


def _row_key() -> Column:
    return F.struct(F.col("doc_id"), F.xxhash64("text").alias("text_hash"))


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def _body(lines: Column, longs: Column, i: Column) -> Column:
    """A long line by itself; a short one with the short one after it; NULL if there is none."""
    line, after = F.get(lines, i), F.get(lines, i + 1)
    pair = F.when(~F.get(longs, i + 1), F.concat(line, F.lit("\n"), after))
    return F.when(F.get(longs, i), line).otherwise(pair)


def _hashes(docs: DataFrame) -> DataFrame:
    """Hash and length of every long line and every pair of short lines."""

    def bodies(t: Column) -> Column:
        return F.transform(t["lines"], lambda _, i: _body(t["lines"], t["longs"], i))

    def marked(lines: Column) -> Column:
        longs = F.transform(lines, lambda x: _is_long(x, LONG_LINE_WORDS))
        return let(F.struct(lines.alias("lines"), longs.alias("longs")), bodies)

    found = docs.select(F.explode(let(F.split(_text(), "\n", -1), marked)).alias("body")).where("body IS NOT NULL")
    return found.select(F.xxhash64("body").alias("chunk_hash"), F.octet_length("body").alias("octets"))


def _places(docs: DataFrame) -> DataFrame:
    """One row per long line and pair of short lines, with its place and how the chunks lie around it."""

    def units(t: Column) -> Column:
        def unit(_: Column, i: Column) -> Column:
            return F.struct(
                (i + 1).alias("pos"),
                F.get(t["longs"], i).alias("long"),
                _body(t["lines"], t["longs"], i).alias("body"),
                F.coalesce(F.get(t["ends"], i - 1), F.lit(True)).alias("starts"),
                (~F.get(t["ends"], i)).alias("inner"),
                F.coalesce(F.get(t["ends"], i + 1), F.lit(True)).alias("stops"),
                F.size(t["lines"]).alias("n_lines"),
            )

        return F.transform(t["lines"], unit)

    parsed = _parsed(_text(), BOUNDARY_DIGITS, LONG_LINE_WORDS, units)
    # The key is made before the lines are: else each of them would hash its text again.
    keyed = docs.select(_row_key().alias("row_key"), "text")
    found = keyed.select("row_key", F.inline(parsed)).where("body IS NOT NULL")
    return found.withColumns({"chunk_hash": F.xxhash64("body"), "octets": F.octet_length("body")})


def repeated_places(docs: DataFrame) -> DataFrame:
    """Every long line and pair of short lines that stands at several places, with its first place (src, src_pos).

    Places go by doc_id, then position. ``members`` is the number of places.
    """
    key = ["chunk_hash", "octets"]
    repeated = keep(_hashes(docs).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key), "chunk-hashes")
    found = join_sized(_places(docs), repeated, key, "left_semi", F.lit(40))
    left, right = F.substring_index("body", "\n", 1), F.substring_index("body", "\n", -1)
    same = F.when(F.col("octets") <= BODY_BYTES, F.col("body")).otherwise(F.sha2("body", 256))
    places = keep(
        found.withColumns(
            {
                "chunk_id": F.struct("chunk_hash", "octets"),
                "same": same,
                "left_hash": F.xxhash64(left),
                "right_hash": F.xxhash64(right),
                "left_words": _words(left),
                "right_words": _words(right),
            }
        ).drop("chunk_hash", "octets", "body"),
        "chunk-places",
    )
    firsts = keep(
        places.groupBy("chunk_id", "same")
        .agg(F.min(F.struct("row_key", "pos")).alias("source"), F.count("*").alias("members"))
        .where("members > 1")
        .withColumnRenamed("same", "first_same"),
        "chunk-firsts",
    )
    joined = join_groups(places, firsts, "chunk_id", "members").where(F.col("same") == F.col("first_same"))
    return joined.withColumns({"src": F.col("source.row_key"), "src_pos": F.col("source.pos")}).drop(
        "chunk_id", "same", "first_same", "source"
    )


def _common_ends(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """The ends of pairs that are common short lines: they stand more than COMMON_TIMES times as often as the pair."""
    lines = docs.select(F.explode(F.split(_text(), "\n", -1)).alias("line")).where(~_is_long(F.col("line"), LONG_LINE_WORDS))
    counts = keep(
        lines.groupBy(F.xxhash64("line").alias("line_hash"))
        .agg(F.count("*").alias("line_places"))
        .where(F.col("line_places") > 2 * COMMON_TIMES),
        "line-counts",
    )
    return join_groups(ends, counts, "line_hash", "line_places").where(F.col("line_places") > COMMON_TIMES * F.col("members"))


def repeated_runs(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """row_key, first and last line of each run that goes, see ``line_dedup``; ``pairs`` are all repeated ones, stored."""
    later = (F.col("row_key") != F.col("src")) | (F.col("pos") != F.col("src_pos"))
    sides = pairs.where(later).select(
        "row_key", "pos", "members", F.inline(F.array(*[
            F.struct(F.lit(right).alias("right"), F.col(h).alias("line_hash")) for right, h in ((False, "left_hash"), (True, "right_hash"))
        ]))
    )
    common = _common_ends(docs, keep(sides, "pair-ends")).select(
        "row_key", "pos", (~F.col("right")).alias("left_common"), F.col("right").alias("right_common")
    )
    rows = pairs.withColumns({"first": ~later, "shift": F.col("src_pos") - F.col("pos")}).drop("left_hash", "right_hash", "members", "src_pos")
    both = keep(rows.unionByName(common, allowMissingColumns=True), "pair-rows").repartition("row_key")
    flags = ("left_common", "right_common")
    one_each = both.groupBy("row_key", "pos").agg(
        *[F.any_value(c, True).alias(c) for c in rows.columns if c not in ("row_key", "pos")],
        *[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in flags],
    )

    # Rows that follow each other, first places and later ones alike.
    text = Window.partitionBy("row_key").orderBy("pos")
    before = F.lag(F.struct("pos", "first", "src", "shift")).over(text)
    after = F.lead(F.struct("pos", "first")).over(text)
    steps = one_each.withColumns(
        {
            "touched": F.coalesce(before["pos"] == F.col("pos") - 1, F.lit(False)),
            "goes_on": F.coalesce(
                (before["pos"] == F.col("pos") - 1) & ~before["first"] & (before["src"] == F.col("src")) & (before["shift"] == F.col("shift")),
                F.lit(False),
            ),
            "guarded": F.coalesce((after["pos"] == F.col("pos") + 1) & after["first"], F.lit(False)),
        }
    ).withColumn("run", F.sum(F.when(F.col("first") | ~F.col("goes_on"), 1).otherwise(0)).over(text))

    # A line that it shares with the run before belongs to that; a line of a first place stays.
    run = Window.partitionBy("row_key", "run")
    begin = F.min(F.col("pos") + F.when(~F.col("goes_on") & F.col("touched"), 1).otherwise(0)).over(run)
    end = F.max(F.col("pos") + F.when(F.col("guarded"), 0).otherwise(1)).over(run)
    left, right = F.when(~F.col("left_common"), F.col("pos")), F.when(~F.col("right_common"), F.col("pos") + 1)
    ranged = steps.where(~F.col("first")).withColumns(
        {"begin": begin, "end": end, "own_begin": F.min(F.least(left, right)).over(run), "own_end": F.max(F.greatest(left, right)).over(run)}
    )
    whole = (F.col("begin") == 1) & (F.col("end") == F.col("n_lines"))
    ranged = ranged.withColumns(
        {
            "first_line": F.when(whole, F.col("begin")).otherwise(F.greatest("begin", F.coalesce("own_begin", F.col("end") + 1))),
            "last_line": F.when(whole, F.col("end")).otherwise(F.least("end", "own_end")),
            "whole": whole,
            "last_pos": F.max("pos").over(run),
        }
    )
    so_far = run.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = F.col("pos").between(F.col("first_line"), F.col("last_line"))
    tail = (F.col("pos") == F.col("last_pos")) & (F.col("pos") < F.col("last_line"))
    judged = ranged.withColumns(
        {
            "words": F.when(within, F.col("left_words")).otherwise(0) + F.when(tail, F.col("right_words")).otherwise(0),
            "chunk_start": F.max(F.when(F.col("starts") & (F.col("pos") >= F.col("first_line")), F.col("pos"))).over(so_far),
        }
    )
    a_chunk = F.col("inner") & F.col("stops") & (F.col("pos") < F.col("last_line")) & F.col("chunk_start").isNotNull()
    runs = judged.groupBy("row_key", "run", "first_line", "last_line", "whole").agg(
        F.sum("words").alias("words"), F.bool_or(a_chunk).alias("has_chunk")
    )
    goes = F.col("whole") | F.col("has_chunk") | (F.col("words") >= LONG_LINE_WORDS)
    return runs.where((F.col("last_line") > F.col("first_line")) & goes).select("row_key", "first_line", "last_line")


def line_dedup(docs: DataFrame) -> DataFrame:
    """The documents with later occurrences of repeated runs of lines cut out of ``text``.

    Added columns: chunks_total (content-defined chunks of the given text), chunks_removed (runs and long lines cut),
    bytes_removed, and emptied (something was cut and nothing is left).

    - Places go by doc_id (NULL first) and position. A line of LONG_LINE_WORDS words or more stays at its first place and
      goes from all others.
    - A pair of neighbouring short lines has a first place too, whose two lines always stay. A run is as many neighbouring
      lines as stand, in one piece, at the first places of their pairs. It goes if it has LONG_LINE_WORDS words, holds a whole
      chunk of several lines, or is the whole text. So every piece that goes is left, in one piece, in one other place.
    - Common short lines at the edges of a run stay (see COMMON_TIMES), unless it is the whole text. A line that two runs
      share belongs to the one before it; what is left of the other goes if it still has two lines.
    - A single short line never goes by itself.
    - NULL text stays NULL and an empty one empty. n_chars follows a changed text.
    - Rows repeated whole are one row as to places: they keep and lose the same.
    - An empty table gives no rows. Input columns with the names of added ones give way.
    """
    docs = docs.drop(*_STEPS)
    repeated = keep(repeated_places(docs), "chunk-repeated")
    line = F.col("pos").cast("int")
    long_lines = repeated.where(
        F.col("long") & ((F.col("row_key") != F.col("src")) | (F.col("pos") != F.col("src_pos")))
    ).select("row_key", line.alias("first_line"), line.alias("last_line"))
    runs = repeated_runs(docs, repeated.where(~F.col("long")).drop("long"))
    cut = keep(
        long_lines.unionByName(runs)
        .groupBy("row_key")
        .agg(F.array_sort(F.collect_set(F.struct("first_line", "last_line"))).alias("cuts")),
        "chunk-cuts",
    )
    joined = join_sized(docs.withColumn("row_key", _row_key()), cut, ["row_key"], "left", 64 + 8 * F.size("cuts"))

    def left_over(lines: Column) -> Column:
        def between(k: Column) -> Column:
            first = F.coalesce(F.get("cuts", k - 1)["last_line"], F.lit(0)) + 1
            until = F.coalesce(F.get("cuts", k)["first_line"], F.size(lines) + 1)
            return F.slice(lines, first, until - first)

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("cuts")), between)), "\n")

    changed = F.col("cuts").isNotNull()
    rebuilt = F.when(changed, let(F.split(_text(), "\n", -1), left_over))
    total = _parsed(_text(), BOUNDARY_DIGITS, LONG_LINE_WORDS, lambda t: F.size(F.filter(t["ends"], lambda end: end)))
    done = joined.withColumn("rebuilt", rebuilt).withColumns(
        {
            "chunks_total": total,
            "chunks_removed": F.when(changed, F.size("cuts")).otherwise(0),
            "bytes_removed": F.when(changed, F.octet_length("text") - F.octet_length("rebuilt")).otherwise(0).cast("long"),
            "emptied": changed & (F.length("rebuilt") == 0),
        }
    )
    done = done.withColumn("text", F.when(changed, F.col("rebuilt")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*docs.columns, "chunks_total", "chunks_removed", "bytes_removed", "emptied")


def op9_line_dedup(spark, sf_dir):
    return line_dedup(documents(spark, sf_dir)).select("doc_id", "text", "chunks_total", "chunks_removed", "bytes_removed")


ORACLE = r"""
WITH lines AS MATERIALIZED (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i
    FROM documents
), counted AS (
    SELECT *, len(list_filter(string_split_regex(line, '[\x09-\x0D\x20]+'), lambda x: x <> '')) AS words FROM lines
), marked AS (
    SELECT *, words >= 50 AS long, lead(line) OVER w AS after, lead(words) OVER w AS words_after, lag(line) OVER w AS previous,
           count(*) OVER (PARTITION BY doc_id) AS n
    FROM counted WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), cut AS (
    SELECT *, long OR coalesce(words_after >= 50, true)
              OR coalesce(substr(md5(md5(previous) || md5(line)), 1, 1) <= '7', false) AS e
    FROM marked
), flagged AS MATERIALIZED (
    SELECT *, coalesce(lag(e) OVER w, true) AS starts, NOT e AS inside, lead(e) OVER w AS stops
    FROM cut WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), totals AS (
    SELECT doc_id, count(*) FILTER (e) AS total FROM cut GROUP BY doc_id
), pairs AS (
    SELECT *, count(*) OVER same AS members, first_value(doc_id) OVER place AS src, first_value(i) OVER place AS src_i
    FROM flagged WHERE NOT long AND words_after < 50
    WINDOW same AS (PARTITION BY line, after), place AS (PARTITION BY line, after ORDER BY doc_id, i)
), common AS (
    SELECT line, count(*) AS places FROM marked WHERE NOT long GROUP BY line
), repeated AS (
    SELECT p.*, src = doc_id AND src_i = i AS first, a.places > 2 * members AS left_common, b.places > 2 * members AS right_common
    FROM pairs p JOIN common a ON a.line = p.line JOIN common b ON b.line = p.after
    WHERE members > 1
), steps AS (
    SELECT *, coalesce(lag(i) OVER w = i - 1, false) AS touched,
           coalesce(lag(i) OVER w = i - 1 AND NOT lag(first) OVER w AND lag(src) OVER w = src AND lag(src_i) OVER w = src_i - 1, false) AS goes_on,
           coalesce(lead(i) OVER w = i + 1 AND lead(first) OVER w, false) AS guarded
    FROM repeated WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
    SELECT *, sum(CASE WHEN first OR NOT goes_on THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM steps
), ranged AS (
    SELECT *, min(i + (NOT goes_on AND touched)::INT) OVER r AS a, max(i + (NOT guarded)::INT) OVER r AS z,
           min(CASE WHEN NOT left_common THEN i WHEN NOT right_common THEN i + 1 END) OVER r AS own_a,
           max(CASE WHEN NOT right_common THEN i + 1 WHEN NOT left_common THEN i END) OVER r AS own_z,
           max(i) OVER r AS last_i
    FROM numbered WHERE NOT first WINDOW r AS (PARTITION BY doc_id, run)
), trimmed AS (
    SELECT *, a = 1 AND z = n AS whole, CASE WHEN a = 1 AND z = n THEN a ELSE greatest(a, coalesce(own_a, z + 1)) END AS f,
           CASE WHEN a = 1 AND z = n THEN z ELSE least(z, own_z) END AS l
    FROM ranged
), chunked AS (
    SELECT *, max(i) FILTER (starts AND i >= f) OVER (PARTITION BY doc_id, run ORDER BY i) AS s FROM trimmed
), runs AS (
    SELECT doc_id, f, l FROM chunked GROUP BY doc_id, run, f, l, whole
    HAVING l > f AND (whole OR bool_or(inside AND stops AND i < l AND s IS NOT NULL)
        OR sum(CASE WHEN i BETWEEN f AND l THEN words ELSE 0 END + CASE WHEN i = last_i AND i < l THEN words_after ELSE 0 END) >= 50)
), cuts AS (
    SELECT * FROM runs
    UNION ALL
    SELECT doc_id, i, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS k FROM marked WHERE long) WHERE k > 1
), gone AS (
    SELECT doc_id, count(*) AS n_cuts, flatten(list(generate_series(f, l))) AS numbers FROM cuts GROUP BY doc_id
), rebuilt AS (
    SELECT l.doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (g.doc_id IS NULL OR NOT list_contains(g.numbers, i)) AS body, any_value(n_cuts) AS n_cuts
    FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id GROUP BY l.doc_id
)
SELECT doc_id,
       CASE WHEN n_cuts > 0 THEN coalesce(body, '') ELSE text END AS text,
       total::INTEGER AS chunks_total, coalesce(n_cuts, 0)::INTEGER AS chunks_removed,
       CASE WHEN n_cuts > 0 THEN strlen(text) - strlen(coalesce(body, '')) ELSE 0 END::BIGINT AS bytes_removed
FROM rebuilt JOIN totals USING (doc_id) JOIN documents USING (doc_id)
"""
