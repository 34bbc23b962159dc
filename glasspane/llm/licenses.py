"""License scans by diagonal voting.

All rolling hashes of word k-grams of a text are joined (a broadcast join: the template table is fixed
and small, see TEMPLATES) to the places of the same k-grams in license templates. A hit at word p of a
text and word q of a template votes for the diagonal p - q; Spark counts the votes of each text, template and
diagonal. Diagonals that follow each other within ``reach``, as left by an inserted or missing word, are merged,
and a candidate is verified on its words. Of a template of m words let c lie in hits, each counted once, and let
the span be n words long: 2 c / (m + n) is its similarity and must be ``enough``, so words that are missing and
words that stand between count alike, and no span drifts far. Words that tell a template from one of another label
which is nearly the same must be among the hits (``Templates.told``). Of verified spans that overlap, the one of the
greatest similarity stays, then the longest; spans that tie all stay.

Templates shorter than k are joined by grams of their own length. The base phrases are templates too, no longer
than k, so that each hit is an occurrence; they stay whatever overlaps them. Words are compared by hashes of 64 bits.

Only hits and a row for each text are shuffled, never texts; nothing is held for a text but its own spans. Null text
counts as empty (no words, no labels, score 0). Each row has a result of its own; rows with the same doc_id (a null
one, too) and text have the same one. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Shelf, in_batches
from .words import ALPHANUMERIC, Words, chunks

GRAM = 3

#: Phrases whose every occurrence is a base place, and their labels (fixed values).
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_DISCLAIMER = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"

#: Notices and texts of common licenses, in words as they are compared (fixed values), and their labels.
TEMPLATES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + _WARRANTY: "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2.0",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd",
    _DISCLAIMER: "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "isc",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely": "zlib",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "distributed under the boost software license version 1 0": "boost",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "boost",
    "licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "licensed under a creative commons attribution noncommercial sharealike 4 0 international license": "cc-by-nc-sa",
    "licensed under a creative commons attribution noderivatives 4 0 international license": "cc-by-nd",
    "licensed under a creative commons attribution noncommercial noderivatives 4 0 international license": "cc-by-nc-nd",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0",
    "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form": "apache-2.0",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "agpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl",
    "you should have received a copy of the gnu general public license along with this program": "gpl",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0": "epl-2.0",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed": "wtfpl",
    "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted": "postgresql",
}


class Templates:
    """The grams of all templates: the base phrases first."""

    def __init__(self, extra: dict[str, str] | None = None):
        table = TEMPLATES | (extra or {})
        self.labels = [*BASE.values(), *table.values()]
        self.base = len(BASE)
        self.words = [Words([t.encode()], ALPHANUMERIC) for t in (*BASE, *table)]
        self.sizes = [len(w.hashes) for w in self.words]
        self.k = [min(GRAM, n) for n in self.sizes]
        self.told = [self.apart(t) for t in range(len(self.words))]

    def apart(self, t: int, alike: float = 0.8) -> list[int]:
        """Places of words that a template of another label lacks of which it has nearly all else."""
        own, places = self.words[t].hashes.tolist(), set()
        for other in range(self.base, len(self.words)):
            if self.labels[other] != self.labels[t]:
                theirs = set(self.words[other].hashes.tolist())
                missing = [q for q, h in enumerate(own) if h not in theirs]
                if len(own) - len(missing) >= alike * len(own):
                    places.update(missing)
        return sorted(places)

    def rows(self) -> list[tuple]:
        """gram, template, spot, k, size, label, told"""
        return [(int(h), t, q, self.k[t], self.sizes[t], self.labels[t], self.told[t]) for t, w in enumerate(self.words) for q, h in enumerate(w.windows(self.k[t]).view(np.int64))]


#: The gram of a row that stands for a whole text (its place is the number of words); its template is -1.
TEXT_ROW = 0


def grams(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, which (a hash of the text), place, gram: a row for each text, and one for each of its grams."""

    def run(batches):
        for batch in batches:
            ids, which = batch.column(0), batch.column(1)
            for at, own in chunks(batch.column(2).to_pylist(), 1 << 18):
                w = Words(own, ALPHANUMERIC)
                columns = [(np.arange(len(own)), np.diff(w.first), np.full(len(own), TEXT_ROW))]
                for k in sizes:
                    hashes = w.windows(k).view(np.int64)
                    place = np.arange(len(hashes))
                    of = np.searchsorted(w.first, place, side="right") - 1
                    inside = place + k <= w.first[of + 1]
                    columns.append((of[inside], (place - w.first[of])[inside], hashes[inside]))
                of, place, gram = (np.concatenate(x) for x in zip(*columns))
                rows = pa.array(at + of)
                yield pa.RecordBatch.from_arrays([ids.take(rows), which.take(rows), pa.array(place.astype(np.int32)), pa.array(gram)], names=["doc_id", "which", "place", "gram"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("which"), text.alias("text"))
    return in_batches(rows, run, "doc_id long, which long, place int, gram long")


def scan(docs: DataFrame, extra: dict[str, str] | None = None, enough: float = 0.8, reach: int = 2) -> DataFrame:
    """doc_id, n_words, base (array of first words of base places with labels) and spans (array of verified
    spans: label, first word, last word, similarity)."""
    spark, shelf = docs.sparkSession, Shelf(docs.sparkSession, "licenses")
    templates = Templates(extra)
    table = spark.createDataFrame([(TEXT_ROW, -1, 0, 0, 0, "", []), *templates.rows()], "gram long, template int, spot int, k int, size int, label string, told array<int>")
    joined = shelf.put(grams(docs, sorted(set(templates.k))).join(F.broadcast(table), "gram").drop("gram"), "hits")
    texts = joined.where("template < 0").select("doc_id", "which", F.col("place").cast("long").alias("n_words"))
    hits = joined.where("template >= 0").distinct()
    one = ["doc_id", "which", "template"]
    votes = hits.withColumn("diagonal", F.col("place") - F.col("spot")).groupBy(*one, "k", "size", "label", "told", "diagonal")
    votes = votes.agg(F.collect_set("spot").alias("spots"), F.min("place").alias("first"), F.max(F.col("place") + F.col("k") - 1).alias("last"))
    ordered = Window.partitionBy(*one).orderBy("diagonal")
    # occurrences of a base phrase are never merged
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(ordered) > reach) | (F.col("template") < templates.base), F.lit(False))
    chained = votes.withColumn("apart", apart.cast("int")).withColumn("chain", F.sum("apart").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    merged = chained.groupBy(*one, "k", "size", "label", "told", "chain").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spots")))).alias("q"), F.min("first").cast("long").alias("first"), F.max("last").cast("long").alias("last"))
    step = F.transform("q", lambda x, i: F.least(F.col("k"), F.coalesce(F.get("q", i + 1) - x, F.col("k"))))
    merged = merged.withColumn("c", F.aggregate(step, F.lit(0), lambda a, x: a + x))
    share = 2 * F.col("c") / (F.col("size") + F.greatest("c", F.col("last") - F.col("first") + 1))
    seen = F.forall("told", lambda t: F.exists("q", lambda x: (x <= t) & (t < x + F.col("k"))))
    spans = merged.withColumn("similarity", share).where((F.col("similarity") >= enough) & seen)
    # spans that can overlap begin within the length of the longest; there are a few for each template
    longest = int(max(templates.sizes) * (2 / enough - 1)) + 1
    near = Window.partitionBy("doc_id", "which").orderBy("first").rangeBetween(-longest, longest)
    method = spans.where(F.col("template") >= templates.base).withColumn("rank", F.struct("similarity", (F.col("last") - F.col("first")).alias("length")))
    beaten = F.exists(F.collect_list(F.struct("first", "last", "rank")).over(near), lambda x: (x["first"] <= F.col("last")) & (F.col("first") <= x["last"]) & (x["rank"] > F.col("rank")))
    spans = spans.where(F.col("template") < templates.base).unionByName(method.withColumn("beaten", beaten).where("not beaten").drop("beaten", "rank"))
    own = F.when(F.col("template") < templates.base, F.struct("first", "label"))
    each = spans.groupBy("doc_id", "which").agg(F.array_sort(F.collect_list(own)).alias("base"), F.array_sort(F.collect_list(F.struct("first", "last", "label", "similarity"))).alias("found"))
    each = each.select(F.col("doc_id").alias("d"), F.col("which").alias("w"), "base", F.transform("found", lambda x: F.struct(*[x[c].alias(c) for c in ("label", "first", "last", "similarity")])).alias("spans"))
    out = texts.join(each, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("which") == F.col("w")), "left")
    nothing = lambda c: F.coalesce(F.col(c), F.array().cast(each.schema[c].dataType)).alias(c)
    return out.select("doc_id", "n_words", nothing("base"), nothing("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query, from the spans."""
    first = F.transform("base", lambda x: x["first"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(first).alias("first_word"),
        F.array_max(first).alias("last_word"),
        joined("base").alias("base_labels"),
        joined("spans").alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda x: x["similarity"])), F.lit(0.0)).alias("score"),
    )
