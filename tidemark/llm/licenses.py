"""License scans by diagonal voting, in DataFrame functions alone.

Every run of k words of a text is hashed and joined to the word runs of known license texts.  Hits of one text and one
template are counted by diagonal (text position less template position), and each diagonal is taken together with those
a few words beside it.  Such a span is verified: its hits are chained in order, and the chain has to cover the template
but for a stated share of edits, the words that tell the license from others included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# Phrases that mark a license, and wordings that are looked for by diagonals.  The words in capitals tell a
# license from others and have to be there.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
TEMPLATES = (
    ("apache-2.0", "licensed under the APACHE license version 2 0"),
    ("cc-by-nc-4.0", "licensed under CC BY NC 4 0"),
    ("gpl-3.0", "this work is licensed under the gnu GENERAL PUBLIC license version 3"),
    ("mit", "released under the MIT license"),
    ("mpl-2.0", "this source code form is subject to the terms of the MOZILLA public license v 2 0"),
    ("cc-by", "this work is licensed under a CREATIVE COMMONS ATTRIBUTION"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    (
        "apache-2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"
        " either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    ("bsd", "REDISTRIBUTION and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (
        "bsd",
        "redistributions of source code must RETAIN the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must REPRODUCE the above copyright notice"
        " this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    (
        "bsd",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness"
        " for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but"
        " not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability"
        " or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu GENERAL PUBLIC license as published by the free software foundation"),
    (
        "gpl",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu GENERAL PUBLIC license for more details",
    ),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu LESSER GENERAL PUBLIC license as published by the free software foundation"),
    ("mit", "PERMISSION is hereby GRANTED free of charge to any person obtaining a copy of this software and associated documentation files"),
    (
        "mit",
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute SUBLICENSE and or sell copies of the software and to permit persons"
        " to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    (
        "mit",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
        " in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with"
        " the software or the use or other dealings in the software",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without FEE is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"
        " permission is granted to anyone to use this software for any purpose including commercial applications and to ALTER it and redistribute it freely subject to the following restrictions",
    ),
    ("unlicense", "this is free and unencumbered software released into the PUBLIC DOMAIN anyone is free to copy modify publish use compile sell or distribute this software"),
)
#: Words of a run, how far the diagonals of a span may lie apart, and the share of a template's words that may be changed,
#: missing or put in.
K, GAP, EDITS = 3, 3, 0.1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SELF = -(1 << 63)  # stands for the text itself among the hashes


def words(text: Column) -> Column:
    """Lower-cased words of a text: runs of letters, digits and whatever is not ASCII."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN)
    return F.array_remove(parts, "")


def _run(ws: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(ws, i + j) for j in range(k)])


def _templates(spark: SparkSession, templates, k: int) -> DataFrame:
    rows = [(t, label, text.split()) for t, (label, text) in enumerate(templates)]
    flat = [(t, label, len(ws), [i for i, w in enumerate(ws) if w.isupper() and w.isalpha()], p, [w.lower() for w in ws[p : p + k]]) for t, label, ws in rows for p in range(len(ws) - k + 1)]
    columns = "t int, label string, t_words int, need array<int>, t_at int"
    table = spark.createDataFrame(flat, f"{columns}, run array<string>")
    own = spark.createDataFrame([(-1, "", 0, [], 0)], columns).withColumn("h", F.lit(_SELF))
    return table.withColumn("h", _run(F.col("run"), F.lit(0), k)).drop("run").unionByName(own)


def _chain(hits: Column, k: int) -> Column:
    """Of hits (at, t_at) in order of the text, those chained that go on in the template: where the chain starts and ends in
    the text, and how many words of the template it covers."""
    start = F.struct(F.lit(-1).alias("first"), F.lit(0).alias("last"), F.lit(0).alias("t_end"), F.lit(-1).alias("t_at"), F.lit(0).alias("covered"))

    def add(s: Column, h: Column) -> Column:
        fresh = h["t_at"] + k - F.greatest(s["t_end"], h["t_at"])
        more = F.struct(
            F.when(s["first"] < 0, h["at"]).otherwise(s["first"]).alias("first"), F.greatest(s["last"], h["at"] + k).alias("last"), F.greatest(s["t_end"], h["t_at"] + k).alias("t_end"),
            h["t_at"].alias("t_at"), (s["covered"] + F.greatest(fresh, F.lit(0))).alias("covered"),
        )
        return F.when(h["t_at"] > s["t_at"], more).otherwise(s)

    return F.aggregate(hits, start, add)


def license_spans(df: DataFrame, key: str = "doc_id", text: str = "text", phrases=PHRASES, templates=TEMPLATES, k: int = K, gap: int = GAP, edits: float = EDITS) -> DataFrame:
    """One row for each row of df: its words, base phrase places, and verified template spans.

    Columns: key, text_hash, n_words, n_base, first_word, last_word, base (array of labels), spans (array of struct with
    label, first_word, last_word, share; empty if none).  Only key and text are read, so other columns cannot clash.  A
    null text counts as empty; a null key is a key like others; repeated rows come as often as they are there.  An empty
    table gives an empty one.  The templates are a fixed list and are broadcast; besides one row for each text, only
    hits are shuffled.  A stretch of hits that repeats any number of times is summed by diagonal before it moves.

    A span counts if its chain of hits covers all words of the template that are in capitals, and all but a share `edits`
    of the others, and has no more than that share of words between that are not the template's.  share is the covered
    words over the longer one of template and span.  Of spans of one template that start within half its length, the one
    with the largest share counts, the first of equals.
    """
    spark = df.sparkSession
    base = df.select(F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), words(F.col(text)).alias("ws"))
    starts = []
    for label, phrase in phrases:
        starts.append((label, _places(F.col("ws"), phrase.split())))
    got = base.select("k", "text_hash", "ws", *[at.alias(f"p{i}") for i, (_, at) in enumerate(starts)])
    every = F.concat(*[F.col(f"p{i}") for i in range(len(starts))])
    runs = F.transform("ws", lambda w, i: F.xxhash64(w, *[F.get(F.col("ws"), i + j) for j in range(1, k)]))  # runs cut short at the end hash fewer words
    labels = F.filter(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (label, _) in enumerate(starts)]), lambda x: x.isNotNull())
    rows = got.select(  # before the generator, as what stands beside it is made anew for each of its rows; outer, as else a filter on it repeats its work
        "k", "text_hash", F.size("ws").cast("long").alias("n_words"), F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("base"), F.concat(F.array(F.lit(_SELF)), runs).alias("hs"),
    )
    facts = ["n_words", "n_base", "first_word", "last_word", "base"]
    rows = rows.select("k", "text_hash", *facts, F.posexplode_outer("hs").alias("at", "h")).withColumn("at", F.col("at") - 1)
    hits = rows.join(F.broadcast(_templates(spark, templates, k)), "h")
    of = ["k", "text_hash", "t", "label", "t_words", "need"]
    votes = hits.groupBy(*of, (F.col("at") - F.col("t_at")).alias("diagonal")).agg(F.min(F.struct(*facts)).alias("facts"), F.count("*").alias("n"), F.collect_set("t_at").alias("seen"))
    beside = Window.partitionBy("k", "text_hash", "t").orderBy("diagonal").rangeBetween(0, gap)
    near = votes.withColumn("near", F.collect_list(F.struct("diagonal", "seen")).over(beside))
    pairs = F.flatten(F.transform("near", lambda x: F.transform(x["seen"], lambda p: F.struct((p + x["diagonal"]).alias("at"), p.alias("t_at")))))
    chains = near.withColumn("chain", F.when(F.col("t") >= 0, _chain(F.array_sort(pairs), k)))
    there = F.array_distinct(F.flatten(F.transform("seen", lambda p: F.sequence(p, p + k - 1))))
    whole = F.flatten(F.collect_list(there).over(beside))
    length = F.col("chain.last") - F.col("chain.first")
    most = F.floor(F.col("t_words") * edits)
    good = (F.col("t_words") - F.col("chain.covered") <= most) & (length - F.col("chain.covered") <= most) & (F.size(F.array_except("need", "whole")) == 0)
    share = F.col("chain.covered") / F.greatest(F.col("t_words"), length)
    spans = chains.withColumn("whole", whole).select(*of[:-1], "facts", "n", F.when(good, F.struct(share.alias("share"), (-F.col("chain.first")).alias("before"), F.col("chain.last").alias("last"))).alias("span"))
    spans = spans.where((F.col("t") < 0) | F.col("span").isNotNull())
    by = Window.partitionBy("k", "text_hash", "t").orderBy(F.desc("span.before"))
    new = F.coalesce((F.lag("span.before").over(by) - F.col("span.before") > F.col("t_words") / 2).cast("int"), F.lit(1))
    spans = spans.withColumn("new", new).withColumn("group", F.sum("new").over(by)).groupBy("k", "text_hash", "t", "label", "group").agg(F.min("facts").alias("facts"), F.max("n").alias("n"), F.max("span").alias("span"))
    found = F.when(F.col("t") >= 0, F.struct("label", (-F.col("span.before")).cast("long").alias("first_word"), (F.col("span.last") - 1).cast("long").alias("last_word"), F.col("span.share").alias("share")))
    out = spans.groupBy("k", "text_hash").agg(F.min(F.when(F.col("t") < 0, F.col("facts"))).alias("facts"), F.max(F.when(F.col("t") < 0, F.col("n"))).alias("n"), F.array_sort(F.collect_list(found)).alias("spans"))
    out = out.select("k", "text_hash", "facts", "spans", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return out.select(F.col("k").alias(key), "text_hash", "facts.*", "spans")


def _places(ws: Column, phrase: list[str]) -> Column:
    """Positions at which a phrase's words stand one after the other."""
    last = F.size(ws) - len(phrase)

    def match(i: Column) -> Column:
        out = F.get(ws, i) == phrase[0]
        for j, w in enumerate(phrase[1:], 1):
            out = out & (F.get(ws, i + j) == w)
        return out

    return F.when((last >= 0) & F.array_contains(ws, phrase[0]), F.filter(F.sequence(F.lit(0), last), match)).otherwise(F.array().cast(T.ArrayType(T.IntegerType())))


def license_labels(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digest of license_spans(): base_labels and labels as comma-joined sorted text, and score, the largest share of a
    template found, or 1 for a base phrase, or 0."""
    ours = F.transform("spans", lambda s: s["label"])
    base = F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.split("base", ","))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)))
    return spans.select(key, "n_words", "n_base", "first_word", "last_word", F.col("base").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, ours)), ",").alias("labels"), F.least(score, F.lit(1.0)).alias("score"))
