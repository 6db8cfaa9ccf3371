"""The query's licences are those of brute force over its paths; a licence file's folder passes on."""

from helpers import SCHEMA

import __spark_entry__ as entry

MIT = "Released under the MIT License."


def test_op3_inherits_along_its_paths(spark, tmp_path):
    rows = [(1, MIT, "a"), (2, "prose", "a"), (3, f"prose and more\n{MIT}\nwords of prose, with many more", "b"), (4, "prose", "b"), (5, None, None), (6, "prose", "a/x"), (7, "Licensed under CC BY-NC 4.0.", "a/x/y"), (8, "text", "a/x/y")]
    spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    own = {1: ("a", "MIT", True), 3: ("b", "MIT", False), 7: ("a/x/y", "CC-BY-NC-4.0", True)}  # folder, name, whether a licence file
    want = {}
    for i, _, source in rows:
        folder = f"corpus/{source or 'unknown'}"
        above = {f"corpus/{f}": name for f, name, whole in own.values() if whole and (folder + "/").startswith(f"corpus/{f}/")}
        near = max(above, key=len, default=None)
        want[i] = (own[i][1], "own") if i in own else (above.get(near), near)
    got = {r.doc_id: (r.license, r.license_from) for r in entry.queries()["op3_license_scan"](spark, str(tmp_path)).collect()}
    assert got == want and want[6] == ("MIT", "corpus/a")
