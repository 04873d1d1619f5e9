"""Helpers of these tests."""


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def as_multiset(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
