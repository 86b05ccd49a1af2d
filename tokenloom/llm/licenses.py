"""Licence scan by a positional rare-token index, in DataFrame expressions alone.

Templates are licence texts and the notices that name them. A pass over the corpus counts in how many files each word
of the templates stands; the index holds, for each template, the places of its rarest words. Of a file, the words that
the index holds are looked up: each posting gives the place where the template would begin. Postings of a template
are intersected by that place: it is an alignment where two postings or more agree. An alignment counts if the
template's mandatory key phrases stand whole at their places and enough of the template's words, weighted by rarity,
stand at theirs. Weights and index are constants of the second pass, which handles each row alone.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm._common import column

#: Phrases and their labels (given).
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label, text or notice, key phrases that must stand whole. Wordings of the public licences and their usual notices.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
        to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
        copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions""", ["permission is hereby granted free of charge", "to deal in the software without restriction"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted free of charge"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of
        the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license
        is distributed on an as is basis without warranties or conditions of any kind either express or implied""", ["in compliance with the license", "without warranties or conditions of any kind"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["general public license"]),
    ("gpl", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free
        software foundation either version 3 of the license or at your option any later version""", ["free software foundation", "general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license", ["affero general public license"]),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer""", ["redistribution and use in source and binary forms"]),
    ("bsd", "released under the bsd license", ["bsd license"]),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright
        notice and this permission notice appear in all copies""", ["permission to use copy modify", "with or without fee"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("epl", "available under the terms of the eclipse public license", ["eclipse public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ["cc0 1 0 universal"]),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this
        software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means""", ["unencumbered software released into the public domain"]),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the
        use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely""", ["in no event will the authors be held liable", "redistribute it freely"]),
    ("boost", "distributed under the boost software license version 1 0", ["boost software license"]),
]
#: Distinct words of a template that the index holds, postings that must agree, and the least score of an alignment.
RARE, AGREE, LEAST = 6, 2, 0.6

#: What stands between words: anything in ASCII but digits and letters.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(template: tuple) -> list[str]:
    return template[1].split()


def vocabulary() -> list[str]:
    """All words of the templates."""
    return sorted({w for t in TEMPLATES for w in words_of(t)})


def weights(files: int, counts: dict[str, int]) -> dict[str, float]:
    """Inverse document frequency of each template word, by the number of files and of those that have it."""
    return {w: math.log((2 + files) / (1 + counts.get(w, 0))) for w in vocabulary()}


def index(weight: dict[str, float]) -> list[dict]:
    """The templates with word weights, rarest words by their places, and key phrases by theirs."""
    out = []
    for template in TEMPLATES:
        label, _, keys = template
        t = words_of(template)
        rare = set(sorted(set(t), key=lambda w: (-weight[w], w))[:RARE])
        places = []
        for key in keys:
            k = key.split()
            places.append((next(i for i in range(len(t)) if t[i : i + len(k)] == k), k))
        out.append({"label": label, "words": t, "weights": [weight[w] for w in t], "rare": [(w, i) for i, w in enumerate(t) if w in rare], "keys": places})
    return out


def needed() -> list[str]:
    """Words one of which a text must have for a base phrase, or for a template's key phrases, to stand in it."""
    out = {"license"} & {w for p in BASE for w in p.split()}
    for _, _, keys in TEMPLATES:
        words = {w for k in keys for w in k.split()}
        if not words & out:
            out.add(max(sorted(words), key=len))
    return sorted(out)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _BETWEEN), "")


def corpus_weights(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """weights() of a corpus: one pass counts files by template word; the driver gets a row for each such word at most."""
    words = F.array_intersect(_words(F.coalesce(column(text).cast("string"), F.lit(""))), _texts(vocabulary()))
    found = docs.select(F.explode(F.concat(words, F.array(F.lit("")))).alias("w")).groupBy("w").count()  # "" stands once for each file
    counts = {r["w"]: r["count"] for r in found.collect()}
    return weights(counts.pop("", 0), counts)


def _texts(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", weight: dict[str, float] | None = None) -> DataFrame:
    """One row per row of docs: what licence words its whole text has.

    Columns key, n_words, n_base (places of base phrases), first_word and last_word (least and greatest start of one,
    words from 0; else null), base_labels, labels (those and the index's; distinct, sorted, comma-joined), score (the
    best alignment's weighted share of matched words; at least 0.5 with a base phrase; else 0), and n_aligned
    (alignments that count). weight: of the templates' words, by default corpus_weights(docs). A null text counts as
    empty: no words, empty labels. Repeated rows and null keys pass through; an empty table gives no rows; other
    columns are not read. The plan of the scan itself has no exchange.
    """
    templates = index(corpus_weights(docs, text) if weight is None else weight)
    likely = "(?i)(?<![a-z0-9])(?:" + "|".join(map(re.escape, needed())) + ")(?![a-z0-9])"
    rows = docs.select(column(key).alias("__key"), F.coalesce(column(text).cast("string"), F.lit("")).alias("__t"))
    key_out, key = key, "__key"
    words = _words(F.col("__t"))
    parts = F.split("__t", _BETWEEN)
    edges = (F.get(parts, F.lit(0)) == "").cast("int") + (F.get(parts, F.size(parts) - 1) == "").cast("int")
    # texts without a word that some phrase must have need no list of words
    rows = rows.select(
        F.col(key),
        F.greatest(F.size(parts) - edges, F.lit(0)).cast("long").alias("n_words"),
        F.when(F.col("__t").rlike(likely), words).otherwise(F.array().cast("array<string>")).alias("w"),
    )
    at = lambda i: F.get(F.col("w"), i)

    # places of base phrases: (first word's place, label)
    def base(x: Column, i: Column) -> Column:
        found = F.lit(None).cast("string")
        for phrase, label in BASE.items():
            first, *rest = phrase.split()
            here = x == F.lit(first)
            for k, word in enumerate(rest, 1):
                here = here & (at(i + k) == F.lit(word))
            found = F.when(here, F.lit(label)).otherwise(found)
        return F.when(x.isin(*{p.split()[0] for p in BASE}), F.struct(i.alias("i"), found.alias("label")))

    placed = F.filter(F.transform("w", base), lambda s: s["label"].isNotNull())

    # alignments: a rare word at place i that stands at p in template t gives (t, i - p)
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, spec in enumerate(templates):
        for word, p in spec["rare"]:
            postings.setdefault(word, []).append((t, p))
    table = F.create_map(*(c for w, ps in postings.items() for c in (F.lit(w), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in ps)))))
    hits = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"].isin(*postings))
    begins = F.array_sort(F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(table, h["x"]), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["p"]).alias("o"))))))
    specs = F.array(
        *(
            F.struct(
                F.lit(s["label"]).alias("label"), _texts(s["words"]).alias("words"), F.array(*map(F.lit, s["weights"])).alias("weights"),
                F.lit(sum(s["weights"])).alias("total"),
                F.array(*(F.struct(F.lit(p).alias("p"), _texts(k).alias("words")) for p, k in s["keys"])).alias("keys"),
            )
            for s in templates
        )
    )

    def judged(a: Column) -> Column:
        spec = F.get(specs, a["t"])
        places = F.sequence(F.lit(0), F.size(spec["words"]) - 1)
        share = F.aggregate(places, F.lit(0.0), lambda s, p: s + F.when(at(a["o"] + p) == F.get(spec["words"], p), F.get(spec["weights"], p)).otherwise(0.0))
        phrase = lambda k: F.forall(F.transform(k["words"], lambda x, i: F.coalesce(at(a["o"] + k["p"] + i) == x, F.lit(False))), lambda b: b)
        return F.struct(spec["label"].alias("label"), F.least(share / spec["total"], F.lit(1.0)).alias("score"), F.forall(spec["keys"], phrase).alias("whole"))

    # places where AGREE postings or more of a template begin it: in order, equal ones stand together
    rows = rows.select(key, "n_words", "w", placed.alias("placed"), begins.alias("begins"))
    agreed = F.array_distinct(F.filter("begins", lambda b, i: b == F.get("begins", i + (AGREE - 1))))
    rows = rows.select(key, "n_words", "w", "placed", agreed.alias("aligned"))
    rows = rows.select(key, "n_words", "placed", F.filter(F.transform("aligned", judged), lambda a: a["whole"] & (a["score"] >= LEAST)).alias("found"))
    starts, labels = F.transform("placed", lambda s: s["i"]), F.transform("placed", lambda s: s["label"])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    n_base = F.size("placed").cast("long")
    best = F.coalesce(F.array_max(F.transform("found", lambda a: a["score"])), F.lit(0.0))
    return rows.select(
        F.col(key).alias(key_out), "n_words", n_base.alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        joined(labels).alias("base_labels"), joined(F.concat(labels, F.transform("found", lambda a: a["label"]))).alias("labels"),
        F.round(F.when(n_base > 0, F.greatest(best, F.lit(0.5))).otherwise(best), 6).alias("score"), F.size("found").cast("long").alias("n_aligned"),
    )


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _list(values) -> str:
    return "[" + ", ".join("'" + v + "'" if isinstance(v, str) else str(v) for v in values) + "]"


def oracle() -> str:
    """The same in SQL of relations: words by place, their files, the index, and joins by place."""
    templates = " union all ".join(f"select {t} as t, '{label}' as label, {_list(words_of(x))} as ws" for t, x in enumerate(TEMPLATES) for label in [x[0]])
    keys = " union all ".join(f"select {t} as t, {_list(k.split())} as ks" for t, (_, _, phrases) in enumerate(TEMPLATES) for k in phrases)
    phrases = " union all ".join(f"select {_list(p.split())} as ks, '{label}' as label" for p, label in BASE.items())
    return f"""with words as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) - 1 as i from (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_BETWEEN}'), lambda v: v <> '') as w from documents)),
templates as ({templates}), spots as (select t, unnest(ws) as x, generate_subscripts(ws, 1) - 1 as p from templates),
phrases as ({phrases}), keys as ({keys}),
files as (select x, count(distinct doc_id) as n from words where x in (select x from spots) group by x),
idf as (select s.x, ln((2 + (select count(*) from documents)) / (1 + coalesce(any_value(files.n), 0))::double) as v from (select distinct x from spots) s left join files using (x) group by s.x),
rare as (select t, x from (select distinct t, x, v from spots join idf using (x)) qualify row_number() over (partition by t order by v desc, x) <= {RARE}),
begins as (select doc_id, t, i - p as o from words join spots using (x) join rare using (t, x) group by all having count(*) >= {AGREE}),
matched as (select b.doc_id, b.t, b.o, sum(v) as v from begins b join spots s on s.t = b.t join words w on w.doc_id = b.doc_id and w.i = b.o + s.p and w.x = s.x join idf on idf.x = s.x group by all),
key_at as (select t, ks, min(p) as p from (select keys.t, ks, s.p, list(n.x order by n.p) as found from keys join spots s on s.t = keys.t join spots n on n.t = s.t and n.p between s.p and s.p + len(ks) - 1 group by all) where found = ks group by t, ks),
key_words as (select t, unnest(ks) as x, p + generate_subscripts(ks, 1) - 1 as p from key_at),
whole as (select b.doc_id, b.t, b.o from begins b join key_words k on k.t = b.t join words w on w.doc_id = b.doc_id and w.i = b.o + k.p and w.x = k.x
  group by b.doc_id, b.t, b.o having count(*) = (select count(*) from key_words y where y.t = b.t)),
total as (select t, sum(v) as v from spots join idf using (x) group by t),
found as (select m.doc_id, label, least(m.v / total.v, 1.0) as score from matched m join whole using (doc_id, t, o) join total using (t) join templates using (t) where m.v / total.v >= {LEAST}),
base as (select w.doc_id, w.i, label from phrases join words w on w.x = ks[1] join words n on n.doc_id = w.doc_id and n.i between w.i and w.i + len(ks) - 1 and n.x = ks[n.i - w.i + 1]
  group by w.doc_id, w.i, label, ks having count(*) = len(ks)),
b as (select doc_id, count(*) as n, min(i) as lo, max(i) as hi, string_agg(distinct label, ',' order by label) as labels from base group by doc_id),
f as (select doc_id, count(*) as n, max(score) as best from found group by doc_id),
l as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from base union all select doc_id, label from found) group by doc_id)
select d.doc_id, (select count(*) from words where words.doc_id = d.doc_id) as n_words, coalesce(b.n, 0) as n_base, b.lo as first_word, b.hi as last_word, coalesce(b.labels, '') as base_labels,
  coalesce(l.labels, '') as labels, round(greatest(coalesce(f.best, 0.0), case when b.n > 0 then 0.5 else 0.0 end), 6) as score, coalesce(f.n, 0) as n_aligned
from documents d left join b using (doc_id) left join f using (doc_id) left join l using (doc_id)"""
