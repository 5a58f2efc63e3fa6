import pytest
from pyspark.sql import functions as F

from gridtide.llm import licenses as m

MIT = m.SHORT_TEXTS[0][1]
BSD = next(t for i, t in m.SHORT_TEXTS if i == "BSD-3-Clause")
STORED = m.stored_texts()


def found(spark, *texts):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, whole string, found int")
    return [(r.whole, r.found) for r in m.scan(docs).orderBy("doc_id").collect()]


def test_every_known_text_is_found_and_has_a_mark(spark):
    import re

    assert all(re.search(m.MARK, t.lower()) for _, t, _ in m.KNOWN)
    got = found(spark, *[t for _, t, _ in m.KNOWN])
    assert [w for w, _ in got] == [i for i, _, _ in m.KNOWN]


def test_variants_of_a_text(spark):
    variants = [
        "Copyright (c) 2019 Somebody\n\n" + MIT,
        "MIT Licence\n\nCopyright 2020-2023, A & B. All rights reserved.\n" + MIT.upper(),
        "/* " + MIT.replace("\n", "\n * ").replace('"', "”") + " */",
        MIT.replace("sublicense", "sub-license").replace("NONINFRINGEMENT", "non-infringement").replace("  ", " "),
    ]
    assert found(spark, *variants) == [("MIT", ["MIT"])] * 4
    assert found(spark, BSD.replace("copyright holder", "copyright owner"))[0][0] == "BSD-3-Clause"


def test_notices_in_longer_texts(spark):
    got = found(
        spark,
        "Some story.\nReleased under the MIT License.\nThe end.",
        "Intro.\n\n" + BSD + "\n\nLicensed under CC BY-NC 4.0\nand then licensed under cc by nc 4.0!",
        "licensed under the apache licence, v2.0",
        "the word license alone", "", None, MIT + " and more", "permission " * 30_000,
    )
    assert got[0] == (None, ["MIT"])
    assert got[1] == (None, ["BSD-3-Clause", "CC-BY-NC-4.0"])  # the last line has other words
    assert got[2] == ("Apache-2.0", ["Apache-2.0"])
    assert all(g == (None, []) for g in got[3:6]) and got[6] == (None, ["MIT"]) and got[7] == (None, [])


def test_licence_texts_inside_other_texts(spark):
    """Whole texts wherever they stand, against a plain search of the canonical forms."""
    spdx, gpl = next(x for x in STORED if x[0] == "GPL-3.0-only")
    code = "int main() { return 0; }\n"
    one_line = " ".join(gpl.split())
    texts = [
        code + "/*\n" + "".join(f" * {x}\n" for x in MIT.split("\n")) + " */\n" + code + code,
        "Intro without a break " + BSD.replace("\n", " ") + " and it goes on",
        *[f"{code}{t}\n{code}" for _, t in STORED],
        MIT[:-1] + "s for ever", MIT[1:], "x" + MIT, MIT[:-20] + " " + MIT, MIT + BSD + "\n" + gpl,
        "permission is hereby granted free of " * 3000 + MIT,
        one_line.replace("GNU GENERAL PUBLIC LICENSE", "GNU GENERAL PUBLIC LICENSE x", 1), "é" + MIT, "é " + MIT,
    ]
    bodies = {(r.spdx, r.body) for r in m.known_texts(spark).where("inside").collect()}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    canon = [r.c for r in docs.orderBy("doc_id").select(m.canonical(F.col("text")).alias("c")).collect()]
    want = [sorted({i for i, b in bodies if f" {b} " in f" {c} "}) for c in canon]
    got = found(spark, *texts)
    assert [f for _, f in got] == want and all(w is None for w, _ in got[:2])
    assert want[0] == ["MIT"] and want[1] == ["BSD-3-Clause"]
    assert all(i in w for (i, _), w in zip(STORED, want[2:]))


def test_known_texts_are_a_parameter(spark):
    docs = spark.createDataFrame([(1, "a b c licence d e f\nMIT"), (2, MIT)], "doc_id long, text string")
    rows = m.scan(docs, known=[("X", "B, c license; d e", True)]).orderBy("doc_id").collect()
    assert [(r.whole, r.found, r.n_texts) for r in rows] == [(None, ["X"], 1), (None, [], 0)]
    rows = m.scan(docs, known=m.KNOWN[:3]).orderBy("doc_id").collect()
    assert [r.found for r in rows] == [[], []]


@pytest.mark.parametrize("n", [0, 3])
def test_repeated_ids_and_empty_table(spark, n):
    docs = spark.createDataFrame([(1, "Released under the MIT License.")] * n + [(None, "x")] * n, "doc_id long, text string")
    assert m.scan(docs).count() == (2 if n else 0)
