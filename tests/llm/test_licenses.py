import random
import re
import string
from collections import Counter
from re import _parser

import pytest
from pyspark.sql import functions as F

from newsloom.llm import licenses
from newsloom.llm.license_rules import BASE, Rule, rules
from tests.llm.frames import frame, odd_rows, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def base(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = []
    for label, phrase in BASE.items():
        phrase = phrase.split()
        places += [(k, label) for k in range(len(words)) if words[k : k + len(phrase)] == phrase]
    return (
        len(words), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None),
        ",".join(sorted({n for _, n in places})),
    )


NOTICES = [
    ("Licensed under CC BY-NC 4.0.", {"cc-by", "cc-by-nc-4.0"}),
    ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}),
    ("Released under the MIT License.", {"mit"}),
    ("under the GNU General Public License, version 3 or later", {"gpl", "gpl-3.0-or-later"}),
    ("SPDX-License-Identifier: BSD-3-Clause", {"spdx-bsd-3-clause"}),
    ("All Rights\n Reserved", {"reserved"}),
    ("wir kommen mit dem Auto und sie sind alle da", set()),
    ("cc by cc-by CC.BY cc by", {"cc-by"}),
    ("écc by and ccby and ecc by", set()),
    ("GPLv3 or LGPL", {"gpl-3.0", "lgpl"}),
    ("Creative Commons Attribution-ShareAlike 4.0 International License", {"cc-by-sa-4.0"}),
]


def test_rules_are_sound():
    made = rules()
    assert len(made) > 300 and len({(r.label, r.pattern) for r in made}) == len(made)
    for rule in made:
        re.compile(licenses.spaced(rule.pattern))
        assert rule.keyword == rule.keyword.lower() and rule.keyword


def test_base_columns(spark):
    rows = odd_rows() + [(700 + i, t) for i, (t, _) in enumerate(NOTICES)]
    rows += [(800, " ".join(prose(i, 9) + ". All rights reserved! cc by" for i in range(200)))]
    got = licenses.scan_licenses(frame(spark, rows)).collect()
    fields = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    assert Counter((r["doc_id"], *(r[f] for f in fields)) for r in got) == Counter((i, *base(t)) for i, t, *_ in rows)
    for r in got:
        labels, own = r["labels"].split(","), r["base_labels"].split(",")
        assert labels == sorted(set(labels)) and (own == [""] or set(own) <= set(labels)) and 0 <= r["score"] <= 1
        assert (r["score"] > 0) == (r["labels"] != "")


def test_labels_and_suppression(spark):
    rows = [(i, f"{prose(i, 12)} {t} {prose(i + 50, 12)}") for i, (t, _) in enumerate(NOTICES)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    for i, (text, want) in enumerate(NOTICES):
        labels = set(filter(None, got[i]["labels"].split(",")))
        assert labels - {"license-hint"} == want, (text, labels)
    detection = next(d for d in got[1]["detections"] if d["label"] == "apache-2.0")
    assert detection["first"] == 12 and detection["words"] == 8


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "")]])
def test_empty(spark, rows):
    got = licenses.scan_licenses(frame(spark, rows)).collect()
    assert [(r["n_words"], r["labels"], r["score"]) for r in got] == [(0, "", 0.0)] * len(rows)


def test_no_python_in_the_plan(spark):
    plan = licenses.scan_licenses(frame(spark, odd_rows()))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEval" not in plan and "BatchEval" not in plan and "MapIn" not in plan


def written_out(parsed):
    """Texts that together take every alternative of a rule's pattern."""
    texts = [""]
    for op, arg in parsed:
        match str(op):
            case "LITERAL":
                parts = [chr(arg)]
            case "IN" if str(arg[0][0]) == "NEGATE":
                parts = ["x"]
            case "IN":
                parts = [chr(c) for o, a in arg for c in ([a] if str(o) == "LITERAL" else a)]
            case "NOT_LITERAL":
                parts = ["x"]
            case "BRANCH":
                parts = [t for branch in arg[1] for t in written_out(branch)]
            case "SUBPATTERN":
                parts = written_out(arg[3])
            case "MAX_REPEAT":
                least, most, again = arg
                parts = [t * n for n in sorted({least, min(most, least + 1)}) for t in written_out(again)]
            case _:
                raise ValueError(op)
        texts = [a + b for a in texts for b in parts]
    return texts


def test_every_alternative_passes_its_keyword_and_the_gate():
    gate = re.compile(licenses.keyword_pattern({k for r in rules() for k in r.keyword.split("|")}), re.ASCII)
    for rule in rules():
        for text in written_out(_parser.parse(rule.pattern)):
            assert re.fullmatch(rule.pattern, text)
            assert any(f" {k}" in f" {text}" for k in rule.keyword.split("|")), (rule, text)
            assert gate.search(f" {text}")


KEPT_APART = [
    ("AS IS, without warranties", "as-is"), ("for noncommercial use", "noncommercial"), ("the FreeBSD License", "bsd-2-clause"),
    ("Simplified License", "bsd-2-clause"), ("Berkeley Software Distribution", "bsd"), ("Open RAIL-M", "openrail"),
    ("Licence Ouverte", "etalab"), ("see the LICENCE", "license-hint"), ("licence file in the root", "license-hint"),
    ("Terms and conditions for use, reproduction, and distribution", "license-text"),
]


def test_no_alternative_is_kept_from_its_rule(spark):
    rows = [(i, f"{prose(3, 9)} {text}. {prose(4, 9)}") for i, (text, _) in enumerate(KEPT_APART)]
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert [i for i, (_, label) in enumerate(KEPT_APART) if label not in got[i]] == []


def plain_resolved(found):
    """By the docstring: those inside another go; of the rest, by priority, those that overlap a better one that stays."""
    outer = []
    for d in found:
        rivals = [e for e in found if e["start"] <= d["start"] and e["end"] >= d["end"]]
        if min(rivals, key=lambda e: (e["start"] - e["end"], e["priority"], e["rank"])) == d:
            outer.append(d)
    kept = []
    for priority in (1, 2, 3, 4):
        kept += [d for d in outer if d["priority"] == priority and not any(e["start"] < d["end"] and d["start"] < e["end"] for e in kept if e["priority"] < priority)]
    return sorted((d["start"], d["end"], d["label"]) for d in kept)


def test_suppression_of_random_detections(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        found = []
        for rank in range(rng.randint(0, 14)):
            start = rng.randint(0, 30)
            found.append({"start": start, "end": start + rng.randint(1, 9), "rank": rank, "priority": rng.randint(1, 4), "label": f"r{rank}"})
        rows.append((i, found))
    df = spark.createDataFrame(rows, f"i int, found {licenses.DETECTION}")
    for order in (F.col("found"), F.reverse("found")):
        got = {r["i"]: r["kept"] for r in df.select("i", licenses.resolved(order).alias("kept")).collect()}
        for i, found in rows:
            assert [(d["start"], d["end"], d["label"]) for d in got[i]] == plain_resolved(found)


def test_suppression_does_not_hang_on_unrelated_hits(spark):
    listed = [Rule("a", "aa", "aa bb cc dd", 2), Rule("b", "bb", "bb cc dd ee", 2), Rule("c", "cc", "cc dd ee ff", 1)]
    for own in (listed, [listed[0], listed[2]]):
        got = licenses.scan_licenses(frame(spark, [(1, "aa bb cc dd ee ff")]), own).first()
        assert got["labels"] == "c"


def plain_places(evened, pattern):
    return [(m.start(), m.end()) for m in re.finditer(pattern, evened)]


def test_detections_are_those_of_every_rule(spark):
    """The keyword search leaves out no rule that matches."""
    rng = random.Random(8)
    texts = [t for t, _ in NOTICES] + [t for t, _ in KEPT_APART]
    rows = [(i, " ".join(rng.sample(texts, 5)) + " " + prose(i, 5)) for i in range(40)] + [(99, "mit license " * 3000), (100, "")]
    df = frame(spark, rows).select("doc_id", licenses.even(F.col("text")).alias("e"))
    got = df.select("doc_id", "e", licenses.detections(F.col("e"), rules()).alias("found")).collect()
    for r in got:
        want = sorted((s, e, rank) for rank, rule in enumerate(rules()) for s, e in plain_places(r["e"], licenses.spaced(rule.pattern)))
        assert sorted((d["start"], d["end"], d["rank"]) for d in r["found"]) == want
