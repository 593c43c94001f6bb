from __future__ import annotations

import textwrap

import duckdb

from tessera.llm import licences


def test_scan(spark, empty):
    mit = next(t for i, t in licences.KNOWN if i == "MIT" and t.startswith("MIT License"))
    rows = [
        (1, mit), (2, "Copyright (c) 2020 Some One\n\n" + mit.upper().replace("LICENSE", "LICENCE").replace(",", " ;")), (3, mit + " more"), (4, "Some text.\nReleased under the MIT Licence\nMore."),
        (5, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."), (6, None), (7, ""), (8, "Copyright 2021 me\nAll rights reserved."), (9, "Released under the MIT License."),
        (12, "C programmers must pay the author ten dollars for each use.\n" + mit), (13, "Copyright terms: this file is proprietary and may not be copied.\n" + mit),
        (14, "Copyright 2020 Acme. Redistribution is prohibited.\n" + mit), (15, "(c) the reader shall pay\n" + mit), (16, "Copyright © 2007-2011, 2015 by Some Firm, Inc. All rights reserved.\n" + mit),
        (17, "# " + "\n# ".join(textwrap.wrap(mit, 60))), (18, "/* Copyright (C) 1999 A. Person <a.person@example.org> */\r\n" + mit.replace("\n", "\r\n")),
        (10, mit), (10, mit), (None, mit), (11, "x " * 50_000 + "\nReleased under the MIT License."),
    ]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, digest string")
    got = sorted(((r["doc_id"], r["license_id"], r["notices"]) for r in licences.scan(df, licences.known_licences(spark)).collect()), key=str)
    want = [
        (1, "MIT", ""), (2, "MIT", ""), (3, None, ""), (4, None, "MIT"), (5, None, "Apache-2.0,CC-BY-NC-4.0"), (6, None, ""), (7, None, ""), (8, None, ""), (9, "MIT", "MIT"),
        (12, None, ""), (13, None, ""), (14, None, ""), (15, None, ""), (16, "MIT", ""), (17, "MIT", ""), (18, "MIT", ""),
        (10, "MIT", ""), (10, "MIT", ""), (None, "MIT", ""), (11, None, "MIT"),
    ]
    assert got == sorted(want, key=str)
    assert licences.scan(empty, licences.known_licences(spark)).count() == 0
    assert {r["license_id"] for r in licences.scan(df, licences.known_licences(spark).limit(0)).collect()} == {None}


def test_sql_twin(spark, docs):
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text")
    con = duckdb.connect()
    con.register("documents", unique.toPandas())
    want = con.execute(licences.ORACLE).df()
    got = licences.scan(unique, licences.known_licences(spark)).toPandas()
    own = lambda f: sorted(map(str, f[["doc_id", "digest", "license_id", "notices"]].fillna("-").values.tolist()))
    # blanks beyond ASCII and controls differ in neither, so all rows are the same
    assert own(got) == own(want)


def test_each_known_text_in_the_usual_layouts(spark, tmp_path):
    """Whole licences, wrapped, commented, with years and other spellings, against a plain comparison of words."""
    rows, want = [], {}
    for name, titles, text in licences.TEXTS:
        for title in titles:
            for layout in (
                lambda t: "\n".join("\n".join(textwrap.wrap(p, 72)) + "\n" for p in t.split("\n\n")),
                lambda t: "\n".join(f" * {x}" for x in textwrap.wrap(t, 60)),
                lambda t: t.upper().replace("LICENSE", "LICENCE"),
            ):
                rows.append((len(rows), f"{title}\n\nCopyright (c) 2019-2024 Jane Q. Doe and contributors\n\n{layout(text)}"))
                want[rows[-1][0]] = name
                rows.append((len(rows), f"{title}\n{layout(text)}\nAnd one more condition applies."))
    (tmp_path / "Short-1.0").write_text("You may do as you like with this.\n")
    rows += [(9000, "you MAY do, as you like\nwith this"), (9001, "You may do as you like.")]
    want[9000] = "Short-1.0"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["license_id"] for r in licences.scan(df, licences.known_licences(spark, str(tmp_path))).collect()}
    assert {k: v for k, v in got.items() if v} == want
    con = duckdb.connect()
    con.register("documents", df.where("doc_id < 9000").toPandas())
    assert {k: v for k, v in con.execute(f"SELECT doc_id, license_id FROM ({licences.ORACLE}) WHERE license_id IS NOT NULL").fetchall()} == {k: v for k, v in want.items() if k < 9000}


def test_digest_is_made_once_a_text(spark):
    """The digest of the entire text is not made again for each of its lines."""
    plan = licences.scan(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string"), licences.known_licences(spark))._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate inline")]
    assert "array_join(lines" not in above
