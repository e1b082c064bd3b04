from pathlib import Path

from edge_rows import EDGES
from rainledger.llm import licence_scan
from rainledger.llm.licence_scan import known_digests, scan
from edge_rows import frame


def test_spellings_and_copyright_lines(spark):
    text = "Copyright (c) 2020 Someone\nRELEASED under the MIT -- Licence!\n(C) Copyright 1999 X\nAll rights reserved."
    rows = [(1, text), (2, "Some text.\nReleased under the MIT License.\nMore."), (3, "released under the mit"), *EDGES[:4], (20, None)]
    got = {r["doc_id"]: r for r in scan(frame(spark, [r for r in rows if r[0] != 1] + [(1, text)]), known_digests(spark)).collect()}
    assert (got[1]["licence"], got[1]["line_licences"]) == ("MIT", "MIT")
    assert (got[2]["licence"], got[2]["line_licences"]) == (None, "MIT")
    assert (got[3]["licence"], got[3]["line_licences"]) == (None, "")
    assert got[20]["licence"] is None


def test_own_list_and_edges(spark, edges):
    known = known_digests(spark, [("Own", "Same text here, word-for-word, in two rows"), ("Other", "Same text here word for word in two rows")])
    got = scan(edges, known).collect()
    assert len(got) == len({(r[0], r[1] or "") for r in EDGES})
    assert {r["doc_id"] for r in got if r["licence"] == "Own"} == {7, 8}


def test_empty(spark, empty):
    assert scan(empty, known_digests(spark)).collect() == []


def test_no_python_in_plan(spark, edges):
    plan = scan(edges, known_digests(spark))._jdf.queryExecution().toString()
    assert "PythonUDF" not in plan and "ArrowEval" not in plan


def test_copyright_lines_and_spellings_across_line_ends(spark):
    body = "You may sub-license it. The copyright holder grants this.\nIN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE."
    wrapped = "You may sub\nlicense it. The copyright\nholder grants this. In no event shall the authors or\nCOPYRIGHT HOLDERS BE LIABLE."
    heads = ["", "(c) 2021 X\n", "© 2021 X\n", "© Example\n", "# Copyright: Example Ltd\n", "Copyright (c) <year> <owner>. All rights reserved.\n"]
    texts = [head + text for head in heads for text in (body, wrapped)]
    got = scan(frame(spark, list(enumerate(texts))), known_digests(spark, [("Own", body)])).collect()
    assert [r["licence"] for r in got] == ["Own"] * len(texts)
    kept = ["(c) You must retain all notices", "copyright notice, this list", "copyright license to reproduce", "Copyright Notice"]
    got = scan(frame(spark, list(enumerate(kept))), known_digests(spark, [("Empty", "")])).collect()
    assert [r["licence"] for r in got] == [None] * len(kept)


def test_whole_licence_files(spark):
    """Files as repositories hold them: with a title, a copyright line, other line ends, and upper-case parts lowered."""
    folder = Path(licence_scan.__file__).parent / "licences"
    rows, want = [], {}
    for file in sorted(folder.glob("*.txt")):
        name, text = file.stem.split("+")[0], file.read_text()
        head = "The MIT License (MIT)\n\n" if name == "MIT" else "BSD 3-Clause License\n" if name == "BSD-3-Clause" else ""
        for copy in (text, text.lower() if "(c)" not in text.lower() else text, f"{head}(c) 2021 Example\n\n{text}"):
            want[len(rows)] = name
            rows.append((len(rows), copy))
    for name in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC"):
        words = (folder / f"{name}.txt").read_text().split()
        for width in (5, 9, 14):
            want[len(rows)] = name
            rows.append((len(rows), "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))))
    got = {r["doc_id"]: r["licence"] for r in scan(frame(spark, rows), known_digests(spark)).collect()}
    assert got == want and {"Apache-2.0", "GPL-2.0", "GPL-3.0", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause"} <= set(want.values())


def test_sql_on_documents_that_are_licences(spark):
    """The tables hold no whole licence, so the SQL is compared on files too: whole, wrapped, with titles and signs."""
    import duckdb

    from checks.compare import differences
    from rainledger.llm.licence_scan import ORACLE, KNOWN

    folder = Path(licence_scan.__file__).parent / "licences"
    files = [f.read_text() for f in sorted(folder.glob("*.txt"))]
    heads = ["", "(c) 2021 X\n", "© Example\n", "MIT License\n\n", "Copyright Example Ltd\n", "Copyright Holder's note\n", "* Copyright: 2020 Y\n"]
    texts = [head + text for head in heads for text in files] + [text.replace("licence", "license") for _, text in KNOWN]
    texts += [" ".join(f.split()) for f in files] + ["", "Copyright notice\nAll rights reserved.", "all rights reserveds\nx", "Portions copyright by Z\ny"]
    rows = list(enumerate(texts))
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    found = scan(frame(spark, rows), known_digests(spark))
    assert found.where("licence IS NOT NULL").count() >= 4 * len(files)
    assert differences(duck, found, ORACLE) is None
