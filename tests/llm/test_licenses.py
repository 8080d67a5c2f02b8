"""Licence scans against SQL, and the canonical form."""

import duckdb
import pytest

from linkloom.llm import licenses
from linkloom.llm.queries import QUERIES

FULL = "The MIT Licence\n\nCopyright (c) 2020 A. Author\n\nPermission is hereby granted, free of charge, to any person."


@pytest.fixture(scope="module")
def cases(spark):
    rows = [
        (1, "Released under the MIT License."),
        (2, "released   UNDER the mit licence"),
        (3, "prose\nReleased under the MIT License!\nmore"),
        (4, "a\n\nLicensed under the Apache License,\nVersion 2.0.\n\nb\n \t\nReleased under the MIT License."),
        (5, None),
        (6, ""),
        (7, "\n\n\n"),
        (8, "The MIT License\nCopyright 1999 Somebody Else\nPermission is hereby granted, free of charge, to any person"),
        (9, "Released under the MIT License. And more."),
        (None, "Licensed under CC BY-NC 4.0"),
        (1, "Released under the MIT License."),
        (10, "word " * 100_000 + "\nThis work is licensed under the GNU GPL, v3"),
        (11, "é Released under the MIT License."),
    ]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, digest string, license_id string")


def test_cases(spark, cases):
    known = licenses.notices(spark).unionByName(spark.createDataFrame([("MIT-text", FULL), ("void", " ,. "), (None, "x")], "license_id string, text string"))
    got = sorted(str((r.doc_id, r.scope, r.part, r.license_id)) for r in licenses.scan_licenses(cases, known).collect())
    whole = lambda doc, name: [(doc, s, 0, name) for s in ("document", "paragraph", "line")]
    want = whole(1, "MIT") * 2 + whole(2, "MIT") + whole(None, "CC-BY-NC-4.0")
    want += [(3, "line", 1, "MIT"), (4, "paragraph", 1, "Apache-2.0"), (4, "paragraph", 3, "MIT"), (4, "line", 7, "MIT")]
    want += [(8, "document", 0, "MIT-text"), (8, "paragraph", 0, "MIT-text"), (10, "line", 1, "GPL-3.0-only")]
    assert got == sorted(map(str, want))
    assert {r.scope for r in licenses.scan_licenses(cases, known, parts=False).collect()} == {"document"}
    assert licenses.scan_licenses(cases.limit(0), known).count() == licenses.scan_licenses(cases, known.limit(0)).count() == 0


def test_query_equals_sql(spark, sf_dir, cases, tmp_path):
    query, sql = QUERIES["op3_licenses"]
    folder = str(tmp_path)
    cases.select("doc_id", "text").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    for path, files in ((sf_dir, f"{sf_dir}/documents.parquet"), (folder, f"{folder}/documents.parquet/*.parquet")):
        base = duckdb.connect()
        base.execute(f"CREATE VIEW documents AS SELECT * FROM '{files}'")
        want = base.execute(sql)
        names = [d[0] for d in want.description]
        got = query(spark, path).select(*names).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_no_python_in_the_plan(spark, sf_dir):
    plan = QUERIES["op3_licenses"][0](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
