"""Licence scans: a positional index of rare licence words, intersected by relative position, with mandatory key phrases."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Label, notice, mandatory key phrases (each stands in the notice).
BASE = [
    ("mit", "mit license", ["mit license"]),
    ("apache", "apache license", ["apache license"]),
    ("gpl", "general public license", ["general public license"]),
]
NOTICES = [
    ("agpl", "licensed under the gnu affero general public license", ["affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("artistic-2.0", "the artistic license 2 0", ["artistic license 2 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use", "source and binary forms"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by", "creative commons attribution 4 0 international", ["creative commons attribution 4 0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international", ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international", ["creative commons attribution sharealike"]),
    ("cc0", "cc0 1 0 universal public domain dedication", ["cc0 1 0 universal"]),
    ("epl-2.0", "eclipse public license version 2 0", ["eclipse public license"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ["permission to use copy modify", "distribute this software"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", ["hereby granted free of charge", "obtaining a copy"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software", "public domain"]),
]


def templates(notices: list = BASE + NOTICES, n_base: int = len(BASE)) -> list[dict]:
    """Notices as word lists, with the places of their key phrases."""
    found = []
    for k, (label, notice, phrases) in enumerate(notices):
        words, keys = notice.split(), []
        for phrase in map(str.split, phrases):
            at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
            keys.append({"at": at, "words": phrase})
        found.append({"label": label, "words": words, "keys": keys, "base": k < n_base})
    return found


def file_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def scan_licenses(df: DataFrame, text_col: str = "text", notices: list | None = None, n_base: int = len(BASE)) -> DataFrame:
    """df's rows in struct "record", n_words, and found: every place where a licence template stands in the text.

    found: array of (label, base, first: word where the first key phrase starts, share of the template's words in place).

    The index holds, for each template, the places of the two words of its key phrases with the highest IDF (over all
    texts of df, ties by place). A text is looked up by these words; where both stand at the template's distance, the
    template's place follows, and every key phrase must stand there word by word. The index has a row or two for each
    template, so it travels as a constant; texts are scanned where they are and nothing is shuffled but the word counts.

    Null texts count as empty and give no places; so do empty tables no rows. All columns of df stay in the record."""
    index = templates(notices or BASE + NOTICES, n_base)
    vocabulary = sorted({w for t in index for key in t["keys"] for w in key["words"]})
    words = file_words(F.col(text_col))
    own = df.select(F.array_intersect(words, F.lit(vocabulary)).alias("w"))
    counts = own.select(F.explode_outer("w").alias("w"), F.lit(1)).groupBy("w").count().collect()  # a row per word of the templates
    n_texts = own.count() if len(vocabulary) else 0
    df_of = {r["w"]: r["count"] for r in counts}
    for t in index:
        places = sorted({(-math.log((n_texts + 1) / (df_of.get(w, 0) + 1)), key["at"] + i, w) for key in t["keys"] for i, w in enumerate(key["words"])})
        (_, t["rare_at"], t["rare"]), (_, t["next_at"], t["next"]) = places[0], next(p for p in places[1:] if p[1] != places[0][1])
    kind = "label string, words array<string>, keys array<struct<at:int,words:array<string>>>, base boolean, rare_at int, rare string, next_at int, next string"
    postings = F.from_json(F.lit(json.dumps(index)), "array<struct<" + re.sub(r"(\w+) (string|int|boolean|array)", r"\1:\2", kind).replace(", ", ",") + ">>")

    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record"), words.alias("w"))
    w = F.col("w")
    rare = sorted({t["rare"] for t in index})
    hits = F.filter(F.transform(w, lambda x, i: F.struct(i.alias("at"), x.alias("word"))), lambda h: h["word"].isin(rare))
    aligned = F.flatten(F.transform(hits, lambda h: F.transform(
        F.filter(postings, lambda t: (t["rare"] == h["word"]) & (F.get(w, h["at"] - t["rare_at"] + t["next_at"]) == t["next"])),
        lambda t: F.struct((h["at"] - t["rare_at"]).alias("from"), t.alias("t")),
    )))

    def stands(c: Column) -> Column:
        return F.forall(c["t"]["keys"], lambda key: (c["from"] + key["at"] >= 0) & (
            F.slice(w, F.greatest(c["from"] + key["at"], F.lit(0)) + 1, F.size(key["words"])) == key["words"]
        ))

    found = F.transform(F.filter(aligned, stands), lambda c: F.struct(
        c["t"]["label"].alias("label"), c["t"]["base"].alias("base"), (c["from"] + c["t"]["keys"][0]["at"]).alias("first"),
        (F.size(F.filter(F.transform(c["t"]["words"], lambda x, i: F.get(w, c["from"] + i) == x), lambda same: same)) / F.size(c["t"]["words"])).alias("share"),
    ))
    none = F.array().cast("array<struct<label:string,base:boolean,first:int,share:double>>")
    return rows.select("record", F.size(w).cast("long").alias("n_words"), F.when(F.arrays_overlap(w, F.lit(rare)), found).otherwise(none).alias("found"))


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in all documents. score: best share of a notice in place; 0.5 if only a base phrase stands."""
    scan = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("found", lambda f: f["base"])
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda f: f["label"]))), ",")
    first = F.transform(base, lambda f: f["first"].cast("long"))
    notices = F.transform(F.filter("found", lambda f: ~f["base"]), lambda f: f["share"])
    return scan.select(
        F.col("record.doc_id").alias("doc_id"), "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("found")).alias("labels"),
        F.greatest(F.coalesce(F.array_max(notices), F.lit(0.0)), F.when(F.size(base) > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def _sql() -> str:
    parts = []
    for t in templates():
        key, words = t["keys"][0], t["words"]
        stands = " AND ".join(f"p - {key['at']} + {k['at']} >= 1 AND list_slice(w, p - {key['at']} + {k['at']}, p - {key['at']} + {k['at'] + len(k['words']) - 1}) = {k['words']}" for k in t["keys"])
        share = " + ".join(f"(CASE WHEN p - {key['at']} + {i} >= 1 AND w[p - {key['at']} + {i}] = '{x}' THEN 1 ELSE 0 END)" for i, x in enumerate(words))
        parts.append(f"SELECT rid, '{t['label']}' AS label, {str(t['base']).lower()} AS base, p - 1 AS first, ({share}) / {len(words)}.0e0 AS share FROM p WHERE word = '{key['words'][0]}' AND {stands}")
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS x FROM documents),
d AS (SELECT rid, doc_id, list_filter(regexp_split_to_array(x, '{SEPARATORS}'), lambda y: y <> '') AS w FROM t),
p AS (SELECT * FROM (SELECT rid, w, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d) WHERE word IN ({', '.join(sorted({repr(t['keys'][0]['words'][0]) for t in templates()}))})),
m AS ({' UNION ALL '.join(parts)}),
g AS (SELECT rid, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
             greatest(coalesce(max(share) FILTER (NOT base), 0), CASE WHEN bool_or(base) THEN 0.5 ELSE 0 END) AS score FROM m GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN g USING (rid)
"""


OP1_SQL = _sql()
