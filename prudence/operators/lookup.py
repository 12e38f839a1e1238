"""Which texts of a small table stand in which documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tokens(text: Column) -> Column:
    return F.split(F.trim(F.lower(text)), r"(?U)\s+")


def containing(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", context: str = "context", item_id: str = "item_id", text: str = "text", least_words: int = 5) -> DataFrame:
    """docs and items, a row for each item that a document contains, case ignored. Names of columns must differ.

    An item of five words or more brings its second to fourth word, which stand whole wherever the item does; documents
    that share such a triple are the candidates of an equi-join, and only they are searched. Shorter items, and none
    else, are compared with every document. Items, a table of bounded size, are broadcast.
    """
    items = items.where(F.trim(text) != "").withColumn("_t", _tokens(F.col(text)))
    long = items.where(F.size("_t") >= least_words).withColumn("_key", F.expr("xxhash64(_t[1], _t[2], _t[3])"))
    # the tokens come out of a generator, so that the lambda doesn't split the text again for every word
    words = docs.select(doc_id, F.explode_outer(F.array(_tokens(F.col(context)))).alias("_t"))
    triples = "if(size(_t) >= 3, transform(sequence(0, size(_t) - 3), i -> xxhash64(_t[i], _t[i + 1], _t[i + 2])), array())"
    keys = words.select(doc_id, F.explode(F.expr(triples)).alias("_key"))
    pairs = keys.join(F.broadcast(long.select(item_id, "_key")), "_key").select(doc_id, item_id).distinct()
    held = F.contains(F.lower(context), F.lower(F.trim(text)))
    some = docs.join(pairs, doc_id).join(F.broadcast(long.drop("_t", "_key")), item_id).where(held)
    rest = docs.join(F.broadcast(items.where(F.size("_t") < least_words).drop("_t")), held)
    return some.unionByName(rest)
