"""Licence texts recognised by the digest of their canonical form."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainledger.llm.tables import documents, join_sized

# Spellings that mean the same in a licence, after lower-casing and without punctuation.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorised", "authorized"),
    ("behaviour", "behavior"),
    ("copyright holder", "copyright owner"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("https", "http"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("noncommercial", "non commercial"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("sub license", "sublicense"),
    ("sublicence", "sublicense"),
    ("whilst", "while"),
    ("wilful", "willful"),
)

# Notices of known licences.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

_SIGN = r"(?:\([cC]\)|©|&copy;)"
_YEAR = r"(?:\d{4}|[\[<{(]\s*(?i:yyyy|year|name|copyright|owner|fullname))"
#: Told on the raw line: word or sign, then a year or a name. Lines of a licence's body that begin with the word stay.
COPYRIGHT_LINE = (
    r"^[^\p{L}\p{N}©(&]*(?i:portions\s+)?(?:"
    rf"{_SIGN}[\s,:-]*{_YEAR}|©\s*\p{{Lu}}"
    rf"|(?:{_SIGN}\s*)?(?i:copyright)[\s,:-]*(?:{_SIGN}|{_YEAR}|(?i:by\s))"
    rf"|(?:{_SIGN}\s*)?Copyright:?\s+(?!(?i:holder|owner|notice|law|licen[cs]e|act|statement|and|or|in)s?\b)\p{{Lu}}"
    r"|(?i:all rights reserved)(?![\p{L}\p{N}]))"
)


def _canonical_line(line: Column) -> Column:
    """Lower case, punctuation to one blank."""
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def _one_spelling(text: Column) -> Column:
    """Equivalent spellings of a canonical line, or of joined ones, to one."""
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for given, one in EQUIVALENT:
        text = F.replace(text, F.lit(f" {given} "), F.lit(f" {one} "))
    return F.trim(text)


def canonical_lines(text: Column) -> Column:
    """The lines without copyright lines and empty ones; spellings are for _one_spelling, as they can cross line ends."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: ~F.rlike(line, F.lit(COPYRIGHT_LINE)))
    return F.filter(F.transform(lines, _canonical_line), lambda line: line != "")


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


#: Title lines that whole licence files begin with; texts of other licences hold their own.
_TITLES = {
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}


def full_texts() -> list[tuple[str, str]]:
    """Licence and text of the files beside this one, with each of its titles; variants are named after a plus sign."""
    found = []
    for file in sorted((Path(__file__).parent / "licences").glob("*.txt")):
        licence, text = file.stem.split("+")[0], file.read_text(encoding="utf-8")
        found += [(licence, head + text) for head in ("", *(f"{title}\n\n" for title in _TITLES.get(licence, ())))]
    return found


def known_digests(spark, known=None) -> DataFrame:
    """licence and digest of a parameter list of licence texts; the first licence wins a shared digest.

    Without a list: the notices of KNOWN and the whole texts and header blocks of ``full_texts``.
    """
    known = (*KNOWN, *full_texts()) if known is None else known
    table = spark.createDataFrame([(i, *pair) for i, pair in enumerate(known)], "place int, licence string, known_text string")
    canonical = _one_spelling(F.array_join(canonical_lines(F.col("known_text")), " "))
    return table.groupBy(_digest(canonical).alias("digest")).agg(F.min_by("licence", "place").alias("licence"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, text_digest, licence of the entire text, and the licences that single lines state.

    - The entire canonical text is joined to the known digests; so is every line that isn't a copyright line.
    - NULL and empty texts have the digest of the empty text and no licence, unless a known text is empty too.
    - Rows with one doc_id and one text are one document; it comes once. A NULL doc_id is a value like others.
    - An empty table gives no rows. Further columns are not read, whatever their names.
    """
    lines = canonical_lines(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", lines.alias("lines")).select(
        "doc_id",
        F.array_insert(
            F.transform(F.array_distinct(F.transform("lines", _one_spelling)), _digest),
            1,
            _digest(_one_spelling(F.array_join("lines", " "))),
        ).alias("digests"),
    )
    units = rows.select(
        "doc_id", F.element_at("digests", 1).alias("text_digest"), F.posexplode("digests").alias("unit", "digest")
    )
    hit_bytes = F.lit(96) + F.octet_length("licence")
    hits = join_sized(units, known, ["digest"], "left", hit_bytes)
    return (
        hits.groupBy("doc_id", "text_digest")
        .agg(
            F.max(F.when(F.col("unit") == 0, F.col("licence"))).alias("licence"),
            F.array_join(
                F.sort_array(F.collect_set(F.when(F.col("unit") > 0, F.col("licence")))), ","
            ).alias("line_licences"),
        )
        .select("doc_id", "text_digest", "licence", "line_licences")
    )


def op3_licence_scan(spark, sf_dir):
    return scan(documents(spark, sf_dir), known_digests(spark))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The same rule in two steps: DuckDB's expressions have no look-ahead.
_SQL_START = r"^[^\p{L}\p{N}©(&]*(?i:portions\s+)?"
_SQL_COPYRIGHT = (
    rf"{_SQL_START}(?:{_SIGN}[\s,:-]*{_YEAR}|©\s*\p{{Lu}}"
    rf"|(?:{_SIGN}\s*)?(?i:copyright)[\s,:-]*(?:{_SIGN}|{_YEAR}|(?i:by\s))|(?i:all rights reserved)(?:[^\p{{L}}\p{{N}}]|$))"
)
_SQL_NAMED = rf"{_SQL_START}(?:{_SIGN}\s*)?Copyright:?\s+\p{{Lu}}"
_SQL_BODY = rf"{_SQL_START}(?:{_SIGN}\s*)?Copyright:?\s+(?i:holder|owner|notice|law|licen[cs]e|act|statement|and|or|in)(?i:s?)\b"


def _sql_spelling(text: str) -> str:
    text = f"' ' || {text} || ' '"
    for given, one in EQUIVALENT:
        text = f"replace({text}, ' {given} ', ' {one} ')"
    return f"trim({text})"


def _sql_lines(source: str, key: str, text: str) -> str:
    """Canonical lines of each text, without copyright lines and empty ones."""
    copyright_line = " OR ".join(
        [
            f"regexp_matches(raw, {_quoted(_SQL_COPYRIGHT)})",
            f"(regexp_matches(raw, {_quoted(_SQL_NAMED)}) AND NOT regexp_matches(raw, {_quoted(_SQL_BODY)}))",
        ]
    )
    return f"""
    SELECT {key}, coalesce(list(line ORDER BY i) FILTER (line <> ''), []) AS lines
    FROM (SELECT {key}, i, CASE WHEN {copyright_line} THEN '' ELSE trim(regexp_replace(lower(raw), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) END AS line
          FROM (SELECT {key}, unnest(string_split(coalesce({text}, ''), chr(10))) AS raw,
                       unnest(generate_series(1, len(string_split(coalesce({text}, ''), chr(10))))) AS i FROM {source}))
    GROUP BY {key}"""


_KNOWN_ROWS = ", ".join(f"({i}, {_quoted(name)}, {_quoted(text)})" for i, (name, text) in enumerate((*KNOWN, *full_texts())))
ORACLE = f"""
WITH given(place, licence, known_text) AS (VALUES {_KNOWN_ROWS}),
known_lines AS ({_sql_lines('given', 'place, licence', 'known_text')}),
known AS (
    SELECT sha256({_sql_spelling("array_to_string(lines, ' ')")}) AS digest, arg_min(licence, place) AS licence FROM known_lines GROUP BY 1
), texts AS ({_sql_lines('documents', 'doc_id', 'text')}),
stated AS (
    SELECT doc_id, string_agg(DISTINCT k.licence, ',' ORDER BY k.licence) AS line_licences
    FROM (SELECT doc_id, unnest(lines) AS line FROM texts) JOIN known k ON sha256({_sql_spelling('line')}) = k.digest GROUP BY doc_id
), digests AS (
    SELECT doc_id, sha256({_sql_spelling("array_to_string(lines, ' ')")}) AS text_digest FROM texts
)
SELECT t.doc_id, t.text_digest, k.licence, coalesce(s.line_licences, '') AS line_licences
FROM digests t LEFT JOIN known k ON k.digest = t.text_digest LEFT JOIN stated s USING (doc_id)
"""
