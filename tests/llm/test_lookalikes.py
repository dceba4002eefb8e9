import unicodedata

import pytest

from spandrel.llm import lookalikes as L

VOCABULARY = ["SIL", "ɛ", "ɑː", "ã", "ɛ̃", "t", "tʃ", "ç", "ɡ", "θ", "β", "ʌ", "l", "n", "a", "i"]
KNOWN = {unicodedata.normalize("NFC", v): v for v in VOCABULARY}


@pytest.mark.parametrize(
    "label,form",
    [
        ("ε", "ɛ"), ("ЅІL", "SIL"), ("ＳＩＬ", "SIL"), ("t∫", "tʃ"), ("ʧ", "tʃ"), ("ｔ‍ʃ", "tʃ"), ("ã", "ã"), ("а̃", "ã"), ("ε̃", "ɛ̃"), ("ç", "ç"), ("g", "ɡ"),
        ("  ɛ​", "ɛ"), ("﻿ɛ　", "ɛ"), ("α:", "ɑː"), ("ɑ꞉", "ɑː"), ("ӏ", "l"), ("ո", "n"), ("ѳ", "θ"),
        ("ˈɛ", None), ("ɛʰ", None), ("t˥", None), ("t t", None), ("", None), ("-", None), ("overflow", None), ("x" * 10_000, None), ("ṯ", None),
    ],
)
def test_forms(label, form):
    assert L.repaired(label, KNOWN) == form


def test_mixed_scripts_first():
    assert L.dominant_script("ԁʒɛ") == ("LATIN", True) and L.dominant_script("аб") == ("CYRILLIC", False) and L.dominant_script("ː") == ("", False)
    assert L.replaced("Sі", "LATIN") == "Si"


def test_operator(spark, rows):
    v = spark.createDataFrame([(x,) for x in VOCABULARY], "ipa_label string")
    data = [(1, "ɛ"), (2, "ε"), (3, None), (2, "ε"), (4, "ˌt"), (5, "t​")]
    df = spark.createDataFrame([(*d, "clash") for d in data], "row_key bigint, label string, form string").repartition(3)
    assert rows(L.repair(df, ["row_key"], "label", v).select("row_key", "form")) == [(2, "ɛ"), (2, "ɛ"), (5, "t")]
    assert rows(L.repair(df, ["row_key"], "label", v.limit(0))) == [] and rows(L.repair(df.limit(0), ["row_key"], "label", v)) == []
