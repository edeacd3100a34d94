"""Operator 9: licence scan with a trained paragraph classifier, in DataFrame operations only.

A text is cut into paragraphs: at blank lines, at line breaks after the end of a sentence, and before
lines that don't begin with a small letter.
All of them, and each of their sentences, so that a statement between others is seen, are compared
with the templates. Those with a cue word, and of the others those that could be confirmed, go to a multinomial logistic regression on hashed word 1- and 2-grams, with
one class for each licence family and one for everything else. The classifier is trained here from
the templates and short forms below, in variants, and from other paragraphs. A held-out part of the variants
calibrates the unknown class: a family is given only if its probability exceeds what CALIBRATE of
the held-out unknown paragraphs reach, and LEAST. A prediction is confirmed if enough of the
paragraph's or sentence's 2-grams are in the family's templates and short forms. A paragraph with
a cue word that gets no family is returned as unknown.

Null and empty texts have no paragraphs; very long ones are scanned whole; repeated rows give
repeated findings; of equal probabilities the family that comes first in the classes is predicted. An
empty table gives an empty result. Other columns of any name don't matter.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.llm.shared import named, written

FEATURES = 1 << 13
#: Variants of each template and other paragraph, quantile of unknown ones, least probability,
#: least share of 2-grams that the templates hold.
VARIANTS, CALIBRATE, LEAST, CONFIRM = 10, 0.99, 0.5, 0.6

#: Usual notices of licence families.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "Licensed under the MIT license. See the LICENSE file for details.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GPL version 2 or later.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License, version 2.1 (LGPL).",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3 (AGPL).",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "Public domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Proprietary": ["All rights reserved. No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher.", "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited."],
}
#: Headings, identifiers and short statements.
SHORT = {
    "MIT": ["MIT License", "The MIT License (MIT)", "SPDX-License-Identifier: MIT", "License: MIT"],
    "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0", "License: Apache-2.0"],
    "BSD": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "SPDX-License-Identifier: BSD-3-Clause", "License: BSD-2-Clause", "License: BSD"],
    "GPL": ["GNU General Public License", "GPL License", "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: GPL-3.0-only", "License: GPL-3.0", "License: GPLv3"],
    "LGPL": ["GNU Lesser General Public License", "LGPL License", "SPDX-License-Identifier: LGPL-2.1-or-later", "License: LGPL-3.0"],
    "AGPL": ["GNU Affero General Public License", "AGPL License", "SPDX-License-Identifier: AGPL-3.0-only", "License: AGPL-3.0"],
    "MPL": ["Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0", "License: MPL-2.0"],
    "CC-BY": ["CC BY 4.0", "SPDX-License-Identifier: CC-BY-4.0", "License: CC-BY-4.0"],
    "CC-BY-SA": ["CC BY-SA 4.0", "SPDX-License-Identifier: CC-BY-SA-4.0", "License: CC-BY-SA-4.0"],
    "CC-BY-NC": ["CC BY-NC 4.0", "SPDX-License-Identifier: CC-BY-NC-4.0", "License: CC-BY-NC-4.0"],
    "Public domain": ["Released into the public domain.", "SPDX-License-Identifier: CC0-1.0", "License: CC0-1.0", "The Unlicense", "SPDX-License-Identifier: Unlicense"],
    "ISC": ["ISC License", "SPDX-License-Identifier: ISC", "License: ISC"],
    "Proprietary": ["All rights reserved.", "Copyright 2020 Example Corp. All rights reserved.", "Copyright (c) 2019 by the authors. All rights reserved.", "Proprietary and confidential.", "License: Proprietary"],
}
UNKNOWN = "unknown"
#: Paragraphs with cue words that are no licences.
OTHERS = [
    "She renewed her driver's licence at the town office before the summer holidays began.",
    "The committee granted permission for the parade to pass the old bridge on Sunday.",
    "The shop sells fishing permits and hunting licences to visitors over eighteen.",
    "Our washing machine came with a two year warranty that covers parts and labour.",
    "The court heard a case about copyright in the songs of a famous band.",
    "A licensed electrician must sign the form when the work has been completed.",
    "The restaurant lost its liquor license after several complaints from neighbours.",
    "Students at MIT built a small robot that can climb stairs and open doors.",
    "Apache helicopters were seen over the valley during the exercise last night.",
    "Public transport in the city is free of charge during the festival.",
    "The museum's permission is required before you take pictures in the main hall.",
    "Version 2.0 of the timetable is published on the board near the entrance.",
    "The general public may visit the garden from April to October.",
    "He works without restriction and copies the old masters in the gallery.",
    "The domain of the function is the set of all real numbers above zero.",
    "The team distributed leaflets in the park and sold copies of the book.",
    "Free software courses are offered at the library every second Tuesday.",
    "The creative writing group met in the commons room to read new stories.",
    "Terms and conditions apply to every ticket that is bought at the counter.",
    "The foundation published a report about the rights of patients in hospitals.",
    "The pilot holds a commercial licence and has flown for twenty years.",
    "Warranties on used cars differ from one dealer to the next.",
    "Please keep the notice on the door until the inspection is over.",
    "The lawyer explained what a patent is and how long it lasts.",
    "Er kam mit dem Zug und fuhr mit seinen Freunden weiter in die Stadt.",
    "La licence de pêche est valable dans tout le département pour une année.",
    "El permiso de conducir se renueva cada diez años en la oficina central.",
]
SENTENCE_END = r"(?<=[.!?;])\s+"
PARAGRAPH_END = r"\n[ \t\r]*\n|(?<=[.!?:;])[ \t\r]*\n|\n(?=[ \t]*[^\p{Ll}\s])"
#: Words of which a licence paragraph has one.
CUE = r"(?i:licen[cs]|copyright|warrant|redistribut|public domain|creative commons|rights reserved|permission is hereby|confidential)|\b(?:MIT|GPL|LGPL|AGPL|BSD|MPL|ISC|CC0|CC|GNU)\b"


def _rows(seed: int = 5) -> list[tuple[str, str, bool]]:
    """(family, paragraph, held out): variants with words left out, cut and put between others."""
    r = random.Random(seed)
    plain = [w for p in OTHERS for w in p.split()]
    out = []
    for family, paragraphs in [*TEMPLATES.items(), (UNKNOWN, OTHERS)]:
        for p in paragraphs:
            out += [(family, p, False)] * 3
            for k in range(VARIANTS if family != UNKNOWN else VARIANTS // 2):
                words = p.split()
                if k % 3 == 0 and len(words) > 12:
                    a = r.randint(0, len(words) // 2)
                    words = words[a : a + max(8, len(words) // 2)]
                elif k % 3 == 1:
                    words = [w for w in words if r.random() > 0.08]
                else:
                    words = [*r.choices(plain, k=r.randint(0, 4)), *words, *r.choices(plain, k=r.randint(0, 4))]
                out.append((family, " ".join(words), k % 4 == 3))
    for family, forms in SHORT.items():
        for p in forms:
            out += [(family, p, False)] * VARIANTS
    for k in range(8 * VARIANTS):
        out.append((UNKNOWN, " ".join(r.choices(plain, k=r.randint(4, 30))), k % 4 == 3))
    return out


def _words(paragraph: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(paragraph), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)


def _pairs(words: Column) -> Column:
    """2-grams; of less than two words, the words."""
    return F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(words)


def _terms(df: DataFrame) -> DataFrame:
    """paragraph -> words, pairs and terms, the sparse features."""
    return df.withColumn("words", _words(F.col("paragraph"))).withColumn("pairs", _pairs(F.col("words"))).withColumn("terms", F.concat("words", "pairs"))


def _literals(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table from literals."""
    return spark.range(1, numPartitions=1).select(F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names, strict=True)]) for row in rows])).alias("r")).select("r.*")


def train(spark: SparkSession):
    """(model, hasher, families in the order of classes, least probability of a family)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    families = [*TEMPLATES, UNKNOWN]
    rows = [(float(families.index(f)), p, held) for f, p, held in _rows()]
    table = _terms(_literals(spark, rows, ["label", "paragraph", "held"]))
    hasher = HashingTF(numFeatures=FEATURES, binary=True, inputCol="terms", outputCol="features")
    table = hasher.transform(table).select("label", "held", "features").coalesce(1).cache()
    model = LogisticRegression(regParam=1e-3, maxIter=60, family="multinomial").fit(table.filter("not held"))
    held = model.transform(table.filter("held").filter(F.col("label") == len(families) - 1))
    best = F.array_max(F.slice(vector_to_array("probability"), 1, len(families) - 1))
    reached = held.agg(F.percentile(best, F.lit(CALIBRATE)).alias("p")).first()["p"] or 0.0
    table.unpersist()
    return model, hasher, families, max(LEAST, float(reached))


def paragraphs(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(_id, place, paragraph): all paragraphs, counted from 0 within the text."""
    ended = F.split(named(text_column).cast("string"), PARAGRAPH_END, -1)
    return docs.select(named(id_column).alias("_id"), F.posexplode(ended).alias("place", "paragraph"))


def _candidates(found: DataFrame, known: list[str]) -> DataFrame:
    """(_id, place, _row, paragraph, cued): the pieces of paragraphs that have a cue word, or enough of
    whose 2-grams are in some forms: no less are in the forms of all families than in those of one."""
    sentences = F.split("paragraph", SENTENCE_END)
    pieces = found.withColumn("_row", F.monotonically_increasing_id()).select("_id", "place", "_row", F.explode(F.array_distinct(F.concat(F.array("paragraph"), sentences))).alias("paragraph"))
    def enough(pairs: Column) -> Column:
        return (F.size(pairs) > 0) & (F.size(F.filter(pairs, lambda p: p.isin(known))) >= CONFIRM * F.size(pairs) - 1e-5)

    # within functions of arrays, so that words and 2-grams are made once
    once = F.get(F.transform(F.transform(F.array(_words(F.col("paragraph"))), lambda w: F.array_distinct(_pairs(w))), enough), F.lit(0))
    judged = pieces.withColumn("cued", F.col("paragraph").rlike(CUE))
    return judged.filter(F.col("cued") | once)


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every paragraph with a cue word, and every other one with a confirmed family: id, place, family,
    probability (6 places), overlap (share of 2-grams in the family's templates, 6 places) and confirmed.
    A paragraph whose sentences have several families has a row for each; the figures are of the piece,
    the paragraph or a sentence, that is confirmed and has the highest probability. A paragraph with a
    cue word and without a family has one row: unknown, with the highest probability that a family
    gets, no overlap and not confirmed."""
    from pyspark.ml.functions import vector_to_array

    spark = docs.sparkSession
    model, hasher, families, least = train(spark)
    forms = [(f, p, 0) for table in (TEMPLATES, SHORT) for f, ps in table.items() for p in ps]
    known = _terms(_literals(spark, forms, ["family", "paragraph", "x"])).groupBy("family").agg(F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("known"))
    pieces = written(_candidates(paragraphs(docs, id_column, text_column), sorted({p for x in known.collect() for p in x["known"]})), "license-pieces")  # a few families
    scored = model.transform(hasher.transform(_terms(pieces)))
    named = F.slice(vector_to_array("probability"), 1, len(families) - 1)
    scored = scored.select("_id", "place", "_row", "cued", "pairs", F.element_at(F.array(*map(F.lit, families)), F.col("prediction").cast("int") + 1).alias("family"), F.array_max(named).alias("p"))
    scored = scored.withColumn("family", F.when((F.col("family") != UNKNOWN) & (F.col("p") >= least), F.col("family")).otherwise(UNKNOWN))
    joined = scored.join(F.broadcast(known), "family", "left")  # as many rows as there are families
    distinct = F.array_distinct("pairs")
    overlap = F.when(F.col("known").isNotNull(), F.round(F.size(F.array_intersect(distinct, F.col("known"))) / F.size(distinct), 6))
    found = joined.select("_id", "place", "_row", "cued", "family", F.round("p", 6).alias("probability"), overlap.alias("overlap")).withColumn("confirmed", F.coalesce(F.col("overlap") >= CONFIRM, F.lit(False)))
    found = found.filter(F.col("cued") | F.col("confirmed"))
    best = found.groupBy("_row", "_id", "place", "family").agg(F.max(F.struct("confirmed", "probability", "overlap")).alias("_b"))
    given = F.max(F.col("family") != UNKNOWN).over(Window.partitionBy("_row"))  # a few families a paragraph
    best = best.withColumn("_given", given).filter(~F.col("_given") | (F.col("family") != UNKNOWN))
    return best.select(F.col("_id").alias(id_column), "place", "family", "_b.probability", "_b.overlap", "_b.confirmed")
