"""Quicker ways to read JSON give the same records."""

import json

from pyspark.sql import functions as F

from scorelattice.functions import lexemes as L
from scorelattice.operators import extract as X

LISTS = [
    '{"r":[{"a":"x","b":1.2300,"c":-0E+05},{},{"a":"12","b":"s:1"}]}',
    '{"q":[],"r":[{"a":"","b":0}]}',
    '{"r":[{"a":1,"a":1}]}', '{"r":[{"a":1}],"r":[]}', '{"q":[{"a":1,"a":2}],"r":[{"a":1}]}',
    '{"r":[{"a":01}]}', '{"r":[{"a":1,}]}', '{"r":[{"a":1},]}', '{"r":[{"a":1}]} x', '{"r":[{"a":NaN}]}', '{"r":[{"a":1}]}\n',
    '{"r":[{"a":"b:1","c":2.50}]}', '{"r":[{"a":"\\u0041","c":2.50}]}', '{"r":[{"a":null,"b":true,"c":[1.50]},3]}', '{"r": [{"a": 1.0}]}',
    '{"r":{"a":1}}', '{"s":[{"a":1}]}', '{}', '[]', '', None,
    '{"r":[' + ",".join('{"a":%d.50}' % i for i in range(2000)) + "]}",
]
METRIC = '{"name":"em","split":"t","value":1.2300},{"name":"f1","mean":1e16}'
RUNS = [
    '{"groups":[{"runs":[{"run_name":"a","metrics":[' + METRIC + ']},{"model":"b","metrics":[{"name":"em","mean":"0.10"}]}]}]}',
    '{"groups":[{"runs":[{"run_name":"a","run_name":"b","metrics":[' + METRIC + "]}]}]}",
    '{"groups":[{"runs":[{"run_name":"a:1","metrics":[' + METRIC + "]}]}]}",
    '{"groups":[{"runs":[{"run_name":"a","metrics":[]}]}]}', '{"groups":[]}', '{"groups":[{"runs":[{"metrics":[' + METRIC + "]}]}]}",
    '[{"run_spec":{"adapter_spec":{"model":"m"}},"stats":[{"name":{"name":"em","split":"t"},"mean":0.0100},{"name":{"name":"f1"},"value":-1.50}]}]',
    '[{"run_spec":{"adapter_spec":{"model":"m"}},"stats":[{"name":{"name":"em"},"mean":01}]}]', "[]", "", None, "[1", '{"groups":1}',
]


def test_lists_are_read_as_with_every_key_compared(monkeypatch):
    got = [L._collection(d, ["r"]) for d in LISTS]
    assert got[2:5] == [None] * 3 and got[0][0][1] == ("b", "n:1.2300") and len(got[-1]) == 2000
    monkeypatch.setattr(L, "_flat_keys", lambda node: -1)
    assert got == [L._collection(d, ["r"]) for d in LISTS]


def test_keys_of_flat_lists_are_compared_only_if_colons_and_keys_differ(monkeypatch):
    class Refuse:
        def decode(self, text):
            raise AssertionError(text)

    monkeypatch.setattr(L, "_TAGGING", Refuse())
    assert L._collection('{"q": [], "r": [{"a": 1.50, "b": "x"}]}', ["r"]) == [[("a", "n:1.50"), ("b", "s:x")]]


def test_plain_runs_do_not_reach_the_parser(spark):
    df = spark.createDataFrame(list(enumerate(RUNS)), "i int, d string")
    plain = [r.i for r in df.where(L._is_plain(F.col("d"), L._RUNS)).select("i").orderBy("i").collect()]
    assert plain == [0, 6]


def test_plain_runs_give_the_same_claims(spark, monkeypatch):
    df = spark.createDataFrame([(str(i), d) for i, d in enumerate(RUNS)], "snapshot_id string, content string")
    got = sorted(map(tuple, X.run_claims(df).collect()), key=repr)
    monkeypatch.setattr(L, "_PLAIN_LENGTH", -1)
    assert got == sorted(map(tuple, X.run_claims(df).collect()), key=repr)
    assert ("0", "a", "em", "t", "1.2300") in got and ("6", "m", "f1", None, "-1.50") in got


def test_decoded_runs_keep_their_spelling():
    assert json.loads(L._spelled('{"a": [1.2300, 1e16, "x"]}')) == {"a": ["1.2300", "1e16", "x"]}
    assert L._spelled('{"a": 1, "a": 1}') is None and L._spelled("﻿{}") is None
