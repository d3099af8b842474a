"""Licence scans with a trained paragraph classifier, with DataFrame operations only.

Paragraphs (parted by blank lines, with their lines folded) become bags of word n-grams in overlapping windows that cover all of
them. A sparse multinomial logistic regression, trained on notices and names of each family in many wordings, tells the family.
One class stands for licences of no known family and one for text that is no licence; the confidence that is asked for is
calibrated on wordings that training didn't see. Each paragraph is also compared with the templates of all families, which
confirms a prediction or adds a family that the classifier missed.

The model is sparse, so most n-grams weigh nothing. A paragraph without a word of any n-gram that speaks for a licence has the
score of an empty text, which is no licence; such paragraphs are sorted out by their words before windows are made, and no other.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop_table, materialize

#: A licence of no known family; text that is no licence.
UNKNOWN, NONE = "unknown", "none"
# Usual notices of each family.
TEMPLATES = {
    "agpl": ["licensed under the GNU Affero General Public License version 3", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"],
    "apache": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License", "unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD License", "licensed under the BSD 3-Clause License"],
    "cc-by": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0": ["dedicated to the public domain under CC0 1.0 Universal", "to the extent possible under law the author has waived all copyright and related rights to this work"],
    "epl": ["made available under the terms of the Eclipse Public License 2.0", "licensed under the Eclipse Public License"],
    "eupl": ["Licensed under the European Union Public Licence", "Licensed under the EUPL, Version 1.2 or later"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3", "you can redistribute it and/or modify it under the terms of the GNU General Public License", "released under the GNU GPL version 2 or later license"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License"],
    "lgpl": ["licensed under the GNU Lesser General Public License version 3", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"],
    "mit": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "licensed under the MIT License"],
    "mpl": ["subject to the terms of the Mozilla Public License, version 2.0", "Licensed under the Mozilla Public License"],
    "proprietary": ["All rights reserved", "no part of this work may be reproduced without permission", "copyright by the author, all rights reserved"],
    "unlicense": ["This is free and unencumbered software released into the public domain", "Released under the Unlicense"],
    "wtfpl": ["Do What The Fuck You Want To Public License", "Released under the WTFPL"],
    "zlib": ["This software is provided as is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", "Released under the zlib License"],
}
#: Names and identifiers of each family.
NAMES = {
    "agpl": ["AGPL-3.0", "AGPLv3", "AGPL", "GNU AGPL version 3", "AGPL-3.0-or-later"],
    "apache": ["Apache-2.0", "Apache 2.0", "Apache License 2.0", "ASL 2.0"],
    "bsd": ["BSD-3-Clause", "BSD-2-Clause", "BSD 2-Clause", "3-clause BSD", "BSD"],
    "cc-by": ["CC-BY-4.0", "CC BY 3.0", "CC BY"],
    "cc-by-nc": ["CC-BY-NC-4.0", "CC BY-NC 3.0", "CC BY-NC"],
    "cc-by-sa": ["CC-BY-SA-4.0", "CC BY-SA 3.0", "CC BY-SA"],
    "cc0": ["CC0-1.0", "CC0"],
    "epl": ["EPL-2.0", "EPL-1.0", "EPL"],
    "eupl": ["EUPL-1.2", "EUPL"],
    "gpl": ["GPL-3.0", "GPL-2.0-only", "GPLv3", "GPLv2", "GPL v2", "GPL v3", "GNU GPL", "GPL", "GPL v2 or later", "GPL version 3 or later", "GPL-3.0-or-later"],
    "isc": ["ISC"],
    "lgpl": ["LGPL-2.1", "LGPL-3.0", "LGPLv3", "LGPLv2.1", "GNU LGPL", "LGPL"],
    "mit": ["MIT", "MIT-0", "Expat"],
    "mpl": ["MPL-2.0", "MPL 2.0", "MPL"],
    "unlicense": ["Unlicense", "The Unlicense"],
    "wtfpl": ["WTFPL"],
    "zlib": ["Zlib", "zlib/libpng"],
}
NAMED = ("SPDX-License-Identifier: {}", "SPDX: {}", "Licensed under {}", "Distributed under {}", "License: {}", "released under the {} license", "this program is {}", "available under the terms of the {}", "the {} license", "code is licensed under the {}, see the file", "{} or", "or {}")
#: Licences of no known family.
STRANGE = (
    "licensed under the Foobar Public License version 2", "released under the Acme Software License", "see the license file for the license terms", "use of this work is governed by the license agreement of the publisher", "distributed under a custom license",
    "SPDX-License-Identifier: LicenseRef-Custom", "License: Artistic-2.0", "License: OFL-1.1", "licensed under the SIL Open Font License", "licensed under the Open Database License", "released under the Artistic License", "licensed under the terms of the Vendor Community License",
    "the license of this package is found in its root folder", "subject to the terms of the license agreement", "this text may be shared under the terms of the licence that comes with it",
)
#: Sentences with the same words that are no licences.
OTHER = (
    "she renewed her driving license at the public office", "the general asked for permission to leave", "the new version of the license plate was released", "a license to drive is granted by the state",
    "the warranty of the car covers the first version", "we need permission from the author of the book", "the Apache people lived under a treaty", "students of MIT released a report", "a GNU is an animal of the plains",
    "the terms of the treaty were modified under pressure", "he lost his license and his rights", "copyright law is taught at the school", "redistribution of wealth is a public matter", "the license was taken by the general public",
    "without a permission no work is done under water", "the commons were released to the public", "licensed teachers work under the new law", "the licensed doctor has the right version", "a warranty and a permission are two things",
    "fishing without a license is not permitted here", "the professor of MIT spoke about software", "an eclipse of the sun was seen by the public", "the union of the european states met", "all seats are reserved for the public", "the software was provided free of charge to the school",
    "in no event will the match be played on sunday", "the public domain of the city is a park", "he may not use this file of the office", "the source of the river and its forms", "conditions at work are met by law", "liable to change at any event", "free software is a topic of the course",
)
_FILLER = "we have seen that the results of each year and their sum are in this table as far as it goes see also our other pages for more of them thank you".split()
#: Words that tell nothing alone; n-grams of nothing else are no features.
STOP = frozenset("a all also an and any are as at be but by do each for from has have he her his if in into is it its may more no not of on one or other our out part see she so such text than that the their them then there these they this to up use was we were what when which who will with without work you your".split())
#: Words of a window, and from one window to the next; longest n-gram.
WINDOW, HOP, N = 48, 24, 3
#: Share of a template's three-word runs that a paragraph must hold; least probability of all families together, and of one of several.
OVERLAP, CONFIDENCE, SHARE = 0.75, 0.5, 0.25
#: Share of unseen texts without a licence that may be taken for one.
FALSE_ALARMS = 0.01


def words(text: Column) -> Column:
    """Words in lower case. The name of one licence is a common word of German where it is written small; it is read as "with"
    there, unless a licence is what follows."""
    plain = F.regexp_replace(text, r"(?<![\p{L}\p{N}])[mM]it(?![\p{L}\p{N}])(?![^\p{L}\p{N}]+[lL]icen[sc])", "with")
    return F.regexp_extract_all(F.lower(plain), F.lit(r"[\p{L}\p{N}]+(?:\.[0-9]+)*"), F.lit(0))


def grams(w: Column, n: int) -> Column:
    """The runs of n words; none where there are fewer."""
    some = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
    return F.when(F.size(w) >= n, some).otherwise(F.array().cast("array<string>"))


def features(w: Column) -> Column:
    """All n-grams."""
    return F.concat(w, *(grams(w, n) for n in range(2, N + 1)))


def template_runs(text: str) -> list[str]:
    """The distinct three-word runs of a template."""
    w = re.findall(r"[^\W_]+(?:\.[0-9]+)*", text.lower())
    return list(dict.fromkeys(" ".join(w[i : i + 3]) for i in range(len(w) - 2)))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def _strings(values: list[str]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<string>")


def template_hits(w: Column) -> Column:
    """The runs of words that are runs of a template of any family."""
    known = _strings(sorted({r for ts in TEMPLATES.values() for t in ts for r in template_runs(t)}))
    return F.array_intersect(known, grams(w, 3))


def confirmed_families(hits: Column) -> Column:
    """The families of which a template is held; not one whose runs are all explained by a template of another family that is held
    with more runs (of the notice of one licence a good part stands in those of its relatives)."""
    all_ = F.array(*(F.struct(F.lit(f).alias("family"), _strings(template_runs(t)).alias("runs")) for f, ts in TEMPLATES.items() for t in ts if template_runs(t)))
    met = F.transform(all_, lambda t: F.struct(t["family"].alias("family"), t["runs"].alias("runs"), F.array_intersect(t["runs"], hits).alias("held")))
    held = F.filter(met, lambda t: F.size(t["held"]) >= F.size(t["runs"]) * OVERLAP)
    explains = lambda y, x: (y["family"] != x["family"]) & (F.size(y["held"]) > F.size(x["held"])) & (F.size(F.array_except(x["held"], y["runs"])) == 0)
    own = lambda ts: F.filter(ts, lambda x: ~F.exists(ts, lambda y: explains(y, x)))
    return _bound(held, lambda ts: F.array_distinct(F.transform(own(ts), lambda x: x["family"])))


def template_overlap(family: Column, hits: Column) -> Column:
    """The largest share of the runs of a template of the family that is held; 0 for no family."""
    share = lambda t: F.size(F.array_intersect(_strings(t), hits)) / len(t)
    out = F.lit(0.0)
    for f, ts in TEMPLATES.items():
        out = F.when(family == f, F.array_max(F.array(*(share(template_runs(t)) for t in ts if template_runs(t))))).otherwise(out)
    return out


def training_rows() -> list[tuple[str, str, int]]:
    """(family, text, part): every notice and name in several wordings; part 1 is kept for calibration."""
    rows = []
    kinds = [(family, t) for family, ts in TEMPLATES.items() for t in ts] + [(UNKNOWN, t) for t in STRANGE] + [(NONE, t) for t in OTHER]
    for k, (family, text) in enumerate(kinds):
        w = text.split()
        around = [_FILLER[(3 * k + i) % len(_FILLER)] for i in range(12)]
        forms = [w, around[:4] + w, w + around[4:9], around[:6] + w + around[6:], around + w + around, ["this", "file", "is"] + w, w + ["see", "the", "file", "for", "details"], ["copyright", "2020"] + w if family != NONE else w[1:]]
        rows += [(family, " ".join(f), int(i in (3, 5))) for i, f in enumerate(forms)]
        if family == NONE:
            rows += [(family, " ".join(w[: len(w) // 2] + around[:5]), 0), (family, " ".join(w[len(w) // 2 :]), 1)]
    for family, names in NAMES.items():
        for k, name in enumerate(names):
            rows += [(family, form.format(name), int((i + k) % 5 == 3)) for i, form in enumerate(NAMED)]
    for k in range(60):
        rows.append((NONE, " ".join(_FILLER[(7 * k + i * (k % 5 + 1)) % len(_FILLER)] for i in range(8 + k % 30)), int(k % 4 == 3)))
    rows += [(NONE, c, i % 2) for i, c in enumerate(("copyright", "permission", "warranty", "redistribution", "rights", "reserved", "with permission", "public", "general public", "version 2", "version 3", "4.0", "2.0", "or later", "v2", "by", "sa", "nc", "the terms of the", "under the", "software", "this software", "this program is", "the file", "code is", "available under"))]
    return rows


class LicenseClassifier:
    """A sparse multinomial model: intercepts by class, weights by n-gram and class, the temperature of its probabilities, and the
    probability of a licence from which one is believed."""

    def __init__(self, classes: list[str], intercepts: list[float], weights: dict[str, list[float]], temperature: float = 1.0, confidence: float = CONFIDENCE):
        self.classes, self.intercepts, self.weights, self.temperature, self.confidence = classes, intercepts, weights, temperature, confidence
        none = classes.index(NONE)
        speaks = [g for g, w in weights.items() if any(x > w[none] for c, x in enumerate(w) if c != none)]
        common = Counter(x for family, text, _ in training_rows() if family == NONE for x in set(_plain_words(text)))
        #: One word of each n-gram that speaks for a licence, the one that other texts have least.
        rarest = lambda run: min(run.split(" "), key=lambda x: (x in STOP, common[x], -len(x), x))
        anchors = {rarest(g) for g in speaks}
        # of every template more than a quarter of the runs hold one, so that no text with three quarters of it is passed over
        for t in (t for ts in TEMPLATES.values() for t in ts):
            runs = template_runs(t)
            bare = [r for r in runs if anchors.isdisjoint(r.split(" "))]
            while bare and len(bare) >= len(runs) * OVERLAP:
                anchors.add(rarest(bare[0]))
                bare = [r for r in bare if anchors.isdisjoint(r.split(" "))]
        self.anchors = sorted(anchors)

    def logits(self, seen: list[str]) -> list[float]:
        return [b + sum(self.weights[g][c] for g in seen) for c, b in enumerate(self.intercepts)]

    def softmax(self, logits: list[float]) -> list[float]:
        e = [math.exp((v - max(logits)) / self.temperature) for v in logits]
        return [v / sum(e) for v in e]

    def seen(self, w: list[str]) -> list[str]:
        """The n-grams of some words that have weights."""
        return sorted({" ".join(w[i : i + n]) for n in range(1, N + 1) for i in range(len(w) - n + 1)} & self.weights.keys())

    def probabilities_of(self, text: str) -> list[float]:
        """As the columns compute them, for calibration and tests."""
        return self.softmax(self.logits(self.seen(_plain_words(text))))

    def probabilities(self, w: Column) -> Column:
        """The probabilities of all classes for the words of a window (p), and for what is left of it without the n-grams that speak
        for the likeliest class (rest), as a text may name two licences."""
        table = F.from_json(F.lit(json.dumps(self.weights)), "map<string,array<double>>")
        start = F.array(*map(F.lit, self.intercepts))

        def softmax(seen: Column) -> Column:
            logits = F.aggregate(seen, start, lambda a, g: F.zip_with(a, F.element_at(table, g), lambda x, y: x + y))
            scaled = _bound(logits, lambda x: F.transform(x, lambda v: F.exp((v - F.array_max(x)) / self.temperature)))
            return _bound(scaled, lambda x: F.transform(x, lambda v: v / F.aggregate(x, F.lit(0.0), lambda a, b: a + b)))

        def both(seen: Column, p: Column) -> Column:
            top = F.array_position(p, F.array_max(p)).cast("int")
            rest = F.filter(seen, lambda g: F.element_at(F.element_at(table, g), top) <= 0)
            return F.struct(p.alias("p"), softmax(rest).alias("rest"))

        seen = F.array_intersect(_strings(sorted(self.weights)), features(w))
        return _bound(seen, lambda s: _bound(softmax(s), lambda p: both(s, p)))

    def believed(self, x: Column) -> Column:
        """Of a window's probabilities the families that are believed (family, probability), or unknown, or nothing."""
        families = [c for c in self.classes if c not in (NONE, UNKNOWN)]

        def named(p: Column) -> Column:
            of = lambda c: F.get(p, F.lit(self.classes.index(c)))
            some = F.filter(F.array(*(F.struct(F.lit(c).alias("family"), of(c).alias("probability")) for c in families)), lambda f: f["probability"] >= SHARE)
            return F.when(1 - of(NONE) - of(UNKNOWN) >= self.confidence, some).otherwise(_nothing())

        any_ = 1 - F.get(x["p"], F.lit(self.classes.index(NONE)))
        strange = F.array(F.struct(F.lit(UNKNOWN).alias("family"), any_.alias("probability")))
        return _bound(named(x["p"]), lambda f: F.when(F.size(f) > 0, F.concat(f, named(x["rest"]))).when(any_ >= self.confidence, strange).otherwise(_nothing()))


def _nothing() -> Column:
    return F.array().cast("array<struct<family:string,probability:double>>")


def _plain_words(text: str) -> list[str]:
    plain = re.sub(r"(?<![^\W_])[mM]it(?![^\W_])(?![\W_]+[lL]icen[sc])", "with", text)
    return re.findall(r"[^\W_]+(?:\.[0-9]+)*", plain.lower())


def train(spark: SparkSession) -> LicenseClassifier:
    """Fit on the fixed notices; the data are some two thousand rows whatever the corpus."""
    classes = sorted([*TEMPLATES, UNKNOWN, NONE])
    made = training_rows()
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps([{"text": t, "label": float(classes.index(f))} for f, t, part in made if part == 0])), "array<struct<text:string,label:double>>")).alias("r")).select("r.*")
    telling = F.filter(features(words(F.col("text"))), lambda g: F.exists(F.split(g, " "), lambda x: ~x.isin(*STOP)))
    known = materialize(rows.withColumn("grams", telling).coalesce(1), "license-training")
    steps = [CountVectorizer(inputCol="grams", outputCol="counts", binary=True, minDF=2), LogisticRegression(featuresCol="counts", labelCol="label", family="multinomial", regParam=0.0008, elasticNetParam=0.9, standardization=False, maxIter=80)]
    model = Pipeline(stages=steps).fit(known)
    drop_table(known)
    vocabulary, coefficients = model.stages[0].vocabulary, model.stages[1].coefficientMatrix.toArray()
    weights = {g: [round(float(x), 6) for x in coefficients[:, i]] for i, g in enumerate(vocabulary) if coefficients[:, i].any()}
    raw = LicenseClassifier(classes, [round(float(x), 6) for x in model.stages[1].interceptVector], weights)
    unseen = [(classes.index(f), raw.logits(raw.seen(_plain_words(t)))) for f, t, part in made if part == 1]

    def loss(temperature: float) -> float:
        out = 0.0
        for label, x in unseen:
            top = max(x) / temperature
            out += math.log(sum(math.exp(v / temperature - top) for v in x)) + top - x[label] / temperature
        return out

    temperature = min((0.2 * 1.15**i for i in range(30)), key=loss)
    calibrated = LicenseClassifier(classes, raw.intercepts, weights, temperature)
    none = classes.index(NONE)
    alarms = sorted((1 - calibrated.probabilities_of(t)[none] for f, t, part in made if part == 1 and f == NONE), reverse=True)
    calibrated.confidence = max(CONFIDENCE, alarms[int(FALSE_ALARMS * len(alarms))] + 1e-9)
    return calibrated


def scan_licenses(docs: DataFrame, classifier: LicenseClassifier, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each paragraph and family that it names or whose notice it holds: doc_id, paragraph (from 0), family, probability,
    template_overlap, confirmed.

    Paragraphs are parted by blank lines, their other line breaks are folded. Each window of WINDOW words, HOP words on from the
    last, is scored; a family counts where the families together reach the calibrated confidence, with its highest probability
    over the windows. confirmed tells that the paragraph holds three quarters of the three-word runs of a template of its family;
    a family that only the templates find has the probability of its best window too. A licence of no known family is "unknown".
    Paragraphs without a licence, null and empty texts have no rows. Whole texts are read; repeated rows and null ids are kept;
    other columns are ignored.
    """
    each = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), r"\n[^\S\n]*\n\s*")).alias("paragraph", "text"))
    worded = each.select("doc_id", "paragraph", words(F.col("text")).alias("w"))
    anchors = _strings(classifier.anchors)
    worded = worded.where(F.arrays_overlap("w", anchors))
    w = F.col("w")
    windows = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil((F.size(w) - WINDOW) / HOP), F.lit(0)).cast("int")), lambda i: F.slice(w, i * HOP + 1, WINDOW))
    scored = F.transform(F.filter(windows, lambda x: F.arrays_overlap(x, anchors)), classifier.probabilities)
    read = worded.select("doc_id", "paragraph", scored.alias("p"), template_hits(w).alias("hits"))
    read = read.select("doc_id", "paragraph", "p", "hits", F.flatten(F.transform("p", classifier.believed)).alias("named"), confirmed_families(F.col("hits")).alias("found"))
    families = F.array_union(F.transform("named", lambda x: x["family"]), "found")
    # unknown only where nothing else is named
    kept = F.filter(families, lambda f: (f != UNKNOWN) | (F.size(families) == 1))
    rows = read.select("doc_id", "paragraph", "p", "hits", "named", "found", F.explode(kept).alias("family"))
    said = F.array_max(F.transform(F.filter("named", lambda x: x["family"] == F.col("family")), lambda x: x["probability"]))
    place = F.array_position(_strings(classifier.classes), F.col("family")).cast("int") - 1
    best = F.array_max(F.transform("p", lambda x: F.get(x["p"], place)))
    return rows.select("doc_id", "paragraph", "family", F.coalesce(said, best, F.lit(0.0)).alias("probability"), template_overlap(F.col("family"), F.col("hits")).alias("template_overlap"), F.array_contains("found", F.col("family")).alias("confirmed"))
