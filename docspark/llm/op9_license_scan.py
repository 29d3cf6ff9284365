r"""License scans by diagonal voting.

All rolling k-grams of a document's words are joined, as hashes, with the positions of the same k-grams in license
templates; the words of a hit are compared as well. A hit at document word p and template word t votes for the diagonal
p - t: an untouched copy puts all its votes on one diagonal, inserted or lost words move the rest to others near by. Votes are
aggregated by document, template and diagonal; neighbouring diagonals, no farther apart than a span may be longer than the
template, are merged, and bundles with fewer votes than a span needs go. In the rest spans are verified: each hit opens one of
STRETCH times the template, in which hits of near diagonals count, and it has to hold at least COVER of the template's
k-grams, and the last one of a notice with a slash in its name, since versions stand there. Of overlapping spans of one template, or of templates that differ in a version or a clause, those with most votes stay, and of these
the fullest.

The template table is a parameter of fixed size, not data; it is broadcast. Hashes of a text are made inside its row, and only
hits (few) are shuffled. The base scan looks for short phrases, word by word.

Cases: null is an empty text: no words, no labels (empty strings), null first and last word, score 0. Rows that repeat with the
same id and text get the same result each; equal ids with different texts are kept apart. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.llm.common import ascii_lower, documents, text_of

#: Phrases of the base scan and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Passages of public licenses and license notices, by the label that a verified span gives (what stands before a slash).
TEMPLATES = {
    "agpl-text": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "apache-2.0-conditions": "you must give any other recipients of the work or derivative works a copy of this license and you must cause any modified files to carry prominent notices stating that you changed the files",
    "apache-2.0-grant": "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    "apache-2.0-header": "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-2.0-notice": "licensed under the apache license version 2 0",
    "apache-2.0-text": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "boost-text": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
    "bsd-3-clause": "may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-conditions": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc0-text": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "gpl-2-notice": "this work is licensed under the gnu general public license version 2",
    "gpl-notice": "this work is licensed under the gnu general public license",
    "gpl-3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-text": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits",
    "lgpl-text": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "mit-conditions": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-notice": "released under the mit license",
    "mit-rights": "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mpl-2.0-text": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "unlicense-text": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib-conditions": "the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required",
    "zlib-text": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
}
#: Names of licenses in notices, by label. An opening goes before each.
NAMES = {
    "agpl-3-notice": ["gnu affero general public license version 3", "gnu affero general public license v3", "agpl version 3", "gnu agpl v3"],
    "apache-2.0-notice": ["apache license version 2 0", "apache license version 2", "apache license 2 0", "apache license v2 0", "apache 2 0 license", "apache software license"],
    "bsd-notice": ["bsd license", "bsd 2 clause license", "bsd 3 clause license", "2 clause bsd license", "3 clause bsd license", "new bsd license", "simplified bsd license", "modified bsd license"],
    "gpl-2-notice": ["gnu general public license version 2", "gnu general public license v2", "gpl version 2", "gnu gpl v2"],
    "gpl-3-notice": ["gnu general public license version 3", "gnu general public license v3", "gpl version 3", "gnu gpl v3"],
    "lgpl-2.1-notice": ["gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "lgpl version 2 1"],
    "lgpl-3-notice": ["gnu lesser general public license version 3", "gnu lesser general public license v3", "lgpl version 3"],
    "isc-notice": ["isc license"],
    "mit-notice": ["mit license", "expat license"],
    "mpl-2.0-notice": ["mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0", "mpl version 2 0"],
    "unlicense-notice": ["unlicense license"],
    "zlib-notice": ["zlib license", "zlib libpng license"],
}
TEMPLATES |= {f"{label}/{opening} the {name}": f"{opening} the {name}" for label, names in NAMES.items() for name in names for opening in ("under", "of")}
TEMPLATES |= {f"unlicense-notice/{x}": f"{x} under the unlicense" for x in ("licensed", "released", "available", "distributed", "published")}
#: The clauses of Creative Commons, by their signs.
CLAUSES = {"by": "attribution", "by-sa": "attribution sharealike", "by-nd": "attribution noderivatives", "by-nc": "attribution noncommercial", "by-nc-sa": "attribution noncommercial sharealike", "by-nc-nd": "attribution noncommercial noderivatives"}
for _signs, _clauses in CLAUSES.items():
    for _v in ("4 0", "3 0", "2 0"):
        _s = _signs.replace("-", " ")
        TEMPLATES |= {f"cc-{_signs}-notice/{x} {_v}": f"{x} {_v}" for x in (f"under cc {_s}", f"under a cc {_s}", f"under the cc {_s}", f"creative commons {_clauses}", f"http creativecommons org licenses {_s}", f"https creativecommons org licenses {_s}")}
        TEMPLATES[f"cc-{_signs}-notice/long {_v}"] = f"creative commons {_clauses.replace('sharealike', 'share alike').replace('noncommercial', 'non commercial').replace('noderivatives', 'no derivatives')} {_v}"
TEMPLATES |= {f"cc0-notice/{x}": x for x in ("under cc0 1 0", "under the cc0 1 0", "under cc0 1 0 universal", "cc0 1 0 universal public domain dedication", "creative commons zero v1 0", "creativecommons org publicdomain zero 1 0")}
K, COVER, STRETCH = 4, 0.6, 1.5
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_array(text: Column) -> Column:
    """Words of lower-cased text: runs of ASCII letters, digits and all characters beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(text), NOT_WORD), "")


def _grams(words: Column, k: int) -> Column:
    """Hashes of all windows of k words, by position."""
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def _family(label: str) -> str:
    """Licenses of the GNU project and Creative Commons' notices differ in a version or a clause: their spans compete. Others do with their own label only."""
    root, kind = label.split("-")[0].replace("lgpl", "gpl").replace("agpl", "gpl"), label.rsplit("-", 1)[-1]
    return f"{root}-{kind}" if root in ("gpl", "cc") else label


def template_grams(spark: SparkSession, templates: dict[str, str], k: int) -> DataFrame:
    """h, gram (its words), name, label, family (within which spans compete), t (position in the template), n_grams, length."""
    rows = spark.createDataFrame([(name, name.split("/")[0], _family(name.split("/")[0]), text) for name, text in sorted(templates.items())], "name string, label string, family string, text string").withColumn("w", words_array(F.col("text")))
    rows = rows.select("name", "label", "family", "w", F.size("w").alias("length"), F.posexplode(_grams(F.col("w"), k)).alias("t", "h"))
    return rows.select("h", F.array_join(F.slice("w", F.col("t") + 1, k), " ").alias("gram"), "name", "label", "family", "t", (F.col("length") - k + 1).alias("n_grams"), "length")


def read_words(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text: with doc_id it names the row), w."""
    return docs.select("doc_id", F.xxhash64(text_of("text")).alias("th"), words_array(text_of("text")).alias("w"))


def spans(read: DataFrame, templates: dict[str, str] = TEMPLATES, k: int = K, cover: float = COVER, stretch: float = STRETCH) -> DataFrame:
    """doc_id, th, label, first_word, last_word, score: verified spans, score being the share of the template's k-grams."""
    known = template_grams(read.sparkSession, templates, k)
    each = read.select("doc_id", "th", "w", F.posexplode(_grams(F.col("w"), k)).alias("p", "h"))
    hits = each.join(F.broadcast(known), "h").filter(F.array_join(F.slice("w", F.col("p") + 1, k), " ") == F.col("gram"))
    votes = hits.select("doc_id", "th", "name", "label", "family", "p", "t", "n_grams", "length").distinct()
    # votes by diagonal, then neighbouring diagonals of a template as one: all hits of a verified span are among them
    template = ["doc_id", "th", "name", "label", "family", "n_grams", "length"]
    lines = votes.groupBy(*template, (F.col("p") - F.col("t")).alias("diagonal")).agg(F.collect_list(F.struct("p", "t")).alias("hits"))
    along = W.partitionBy("doc_id", "th", "name").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > (stretch - 1) * F.col("length"), F.lit(True))
    merged = lines.withColumn("bundle", F.sum(far.cast("int")).over(along))
    merged = merged.withColumn("total", F.sum(F.size("hits")).over(W.partitionBy("doc_id", "th", "name", "bundle"))).filter(F.col("total") >= cover * F.col("n_grams"))
    votes = merged.select(*template, "bundle", F.explode("hits").alias("hit")).select(*template, "bundle", "hit.p", "hit.t")
    # the window's bound is loose, the words are counted below
    ahead = W.partitionBy("doc_id", "th", "name", "bundle").orderBy(F.col("p") / (stretch * F.col("length"))).rangeBetween(0, 1)
    opened = votes.withColumn("near", F.collect_list(F.struct("p", "t")).over(ahead)).filter(F.size("near") >= cover * F.col("n_grams"))
    p, d, length = F.col("p"), F.col("p") - F.col("t"), F.col("length")
    inside = F.filter("near", lambda x: (x["p"] + k - p <= stretch * length) & (F.abs(x["p"] - x["t"] - d) <= (stretch - 1) * length))
    held = opened.withColumn("near", inside).withColumn("votes", F.size(F.array_distinct(F.transform("near", lambda x: x["t"])))).filter((F.col("votes") >= cover * F.col("n_grams")) & (~F.col("name").contains("/") | F.exists("near", lambda x: x["t"] == F.col("n_grams") - 1)))
    found = held.select("doc_id", "th", "label", "family", p.alias("first_word"), (F.array_max(F.transform("near", lambda x: x["p"])) + k - 1).alias("last_word"), "votes", (F.col("votes") / F.col("n_grams")).alias("score"))
    order = W.partitionBy("doc_id", "th", "family").orderBy("first_word", "last_word", "label", "votes", "score")
    apart = F.col("first_word") > F.coalesce(F.max("last_word").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))
    islands = found.withColumn("island", F.sum(apart.cast("int")).over(order))
    best = W.partitionBy("doc_id", "th", "family", "island")
    top = islands.withColumn("most", F.max(F.struct("votes", "score")).over(best)).filter("struct(votes, score) = most")
    return top.groupBy("doc_id", "th", "family", "island", "label").agg(F.max_by(F.struct("first_word", "last_word", "score"), F.struct("score", -F.col("first_word"))).alias("s")).select("doc_id", "th", "label", "s.*")


def _places(words: Column, phrase: str) -> Column:
    """Starts of a phrase in an array of words."""
    parts = phrase.split()
    at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: _all(F.get(words, i + j) == p for j, p in enumerate(parts)))
    return F.when(_all(F.array_contains(words, p) for p in parts), at).otherwise(F.array().cast("array<int>"))


def _marked(label: str):
    return lambda i: F.struct(i.alias("start"), F.lit(label).alias("label"))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def base_scan(read: DataFrame, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """doc_id, th, n_words, places: array of (start, label)."""
    places = F.concat(*[F.transform(_places(F.col("w"), p), _marked(label)) for p, label in phrases.items()])
    return read.select("doc_id", "th", F.size("w").cast("long").alias("n_words"), places.alias("places"))


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """Base results per row of docs, and verified spans."""
    read = read_words(docs)
    return base_scan(read), spans(read, templates)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, places of base phrases, labels of both kinds and the best span's score (1 where a base phrase stands)."""
    base, found = license_scan(documents(spark, sf_dir))
    best = found.groupBy("doc_id", "th").agg(F.collect_set("label").alias("more"), F.max("score").alias("best")).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "more", "best")
    rows = base.join(best, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    starts, own = F.transform("places", lambda x: x["start"]), F.array_sort(F.array_distinct(F.transform("places", lambda x: x["label"])))
    every = F.array_sort(F.array_distinct(F.concat(own, F.coalesce("more", F.array().cast("array<string>")))))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(own, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
