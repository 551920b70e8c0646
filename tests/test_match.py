"""Value matching against brute force (contains + difflib)."""

import difflib

from tessera.operators import match as M


def test_best_columns_brute_force(spark):
    vals = spark.createDataFrame([
        ("t", "a", "Blue-Widget"), ("t", "a", "red car"), ("t", "b", "CENTC!"), ("u", "c", "centx"),
        ("u", "c", "widgets"), ("u", "d", "centcx"), ("u", "d", "abcdefgh")], "table string, column string, value string")
    vdf = vals.select("table", "column", M.normalise(vals["value"]).alias("v"))
    kws = spark.createDataFrame([("widget",), ("centc",), ("abcdefgx",), ("zzz",)], "keyword string")
    kdf = kws.select("keyword", M.normalise(kws["keyword"]).alias("k"))
    got = {(r["keyword"], r["table"], r["column"]): round(r["score"], 9)
           for r in M.best_columns(kdf, vdf).collect()}
    want = {}
    for kw in ["widget", "centc", "abcdefgx", "zzz"]:
        for t, c, v in [(r["table"], r["column"], r["v"]) for r in vdf.collect()]:
            s = 1.0 if kw in v else difflib.SequenceMatcher(None, kw, v).ratio()
            if s >= 0.8:
                want[(kw, t, c)] = max(want.get((kw, t, c), 0), round(s, 9))
    assert got == want
