"""The pipeline's stages, one after another, against what each should do."""

import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402

from tests.llm.test_search_operators import plain_components  # noqa: E402
from tests.llm.test_text_operators import W, plain_rules  # noqa: E402
from tidemark.llm import packing, simhash  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents():
    rng = np.random.default_rng(11)
    words = [f"{a}{b}" for a in ("ta", "ri", "mo", "ne", "the") for b in ("na", "lo", "si", "ker", "of")] + ["the", "of", "and"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(25, 120))), "en", f"s{i % 4}") for i in range(80)]
    rows += [(100 + i, rows[i][1], "en", "s1") for i in range(10)]
    rows += [(200, rows[3][1] + " write to some.one@mail.example.com", "en", "s2"), (300, "too short", "en", "s0"), (301, None, "en", None), (302, "*** $$$ " * 40, "en", "s0"), (303, "", None, None)]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


def test_stages(spark, tmp_path):
    spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "mix", "pack"]
    out = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        assert name == "pack" or docs.columns == COLUMNS
        out.append(docs.collect())
    rules, near, pii, mixed, pieces = out
    assert {r.doc_id for r in rules} == {i for i, t, *_ in documents() if not plain_rules(t)[5] and i != 302}
    groups = plain_components([r.doc_id for r in rules], [simhash.wide_fingerprint(r.text, 5)[0] for r in rules], 8)
    assert sorted(r.doc_id for r in near) == sorted(set(groups.values()))  # none of these is verified away
    assert sorted(r.doc_id for r in pii) == sorted(r.doc_id for r in near) and not any(re.search(r"\w@\w", r.text) for r in pii)
    assert all(r.n_chars == len(r.text) for r in pii)
    size = {r.doc_id: len(W.findall(r.text)) for r in pii}
    taken = Counter()
    for r in mixed:
        taken[r.doc_id] += len(W.findall(r.text))
    assert all(n <= 3 * size[i] for i, n in taken.items()) and abs(sum(taken.values()) - sum(size.values())) < 100
    own = packing.worker_tokenizer(packing.default_tokenizer())
    assert sum(r.length for r in pieces) == sum(len(own.ids(r.text)) + 1 for r in mixed)
    assert all(len(r.ids) == r.length for r in pieces)
    done = corpus_pipeline.run(spark, str(tmp_path))
    assert done.count() > 0 and done.columns[-1] == "ids"


def test_empty_and_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, __n int, `row` string"
    good = [(i, t, lang, s, n, 1, 2, "x") for i, t, lang, s, n in documents()[:3]]
    odd = [(None, good[0][1], None, None, None, None, None, None), (None, good[1][1] + " and more of it", "en", None, 3, 1, 1, "r"), (0, good[2][1], "en", "s0", 1, 1, 1, "q"), (7, "word " * 30_000, "en", "s", 1, 1, 1, "")]
    for n, rows in enumerate(([], good + odd)):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{n}/documents.parquet")
        names = docs.columns
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, "").write.parquet(f"{tmp_path}/{n}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{n}/{k}")
            assert (docs.count() > 0) == (n > 0) and (name == "pack" or docs.columns == names)
        assert corpus_pipeline.run(spark, f"{tmp_path}/{n}").count() == docs.count()
