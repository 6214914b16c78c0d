"""The corpus pipeline against brute force, stage by stage, on a small corpus."""

import importlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from test_near_dup import brute as near_brute  # noqa: E402
from test_quality import brute as quality_brute  # noqa: E402
from test_repeats import brute as repeats_brute  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from weftwise.llm.common import materialise, work_dir  # noqa: E402
from weftwise.llm.queries import vocabulary_path  # noqa: E402

pipeline = importlib.import_module("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghé"), rng.integers(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(60)
    texts = [prose(int(rng.integers(20, 200))) for _ in range(25)]
    texts += [texts[3], texts[3].replace(texts[3].split()[4], "changed", 1), f"{prose(40)} {passage} {prose(30)}", f"{prose(25)} {passage} {prose(35)}", "too short", None, "| ".join(prose(60).split()), f"{prose(30)} me.too@mail.example.com {prose(20)}"]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


def test_stages(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "near_dedup", "suffix_dedup", "pii_surrogates", "packing"]
    for name, stage in pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = materialise(stage(spark, docs, None), f"{work_dir(spark)}/{name}")
        if name != "packing":
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
            after = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect()) or name in ("quality_rules", "near_dedup")
        if name == "quality_rules":
            assert {29, 30, 31}.isdisjoint(after) and {d for d, t in before.items() if d < 29 and not quality_brute(t)[-1]} == set(after) - {32}
        elif name == "near_dedup":
            assert set(after) == {d for d, v in near_brute(list(before.items())).items() if v[2]} and 25 not in after
        elif name == "suffix_dedup":
            want = {d: n for d, _, n, _, _ in repeats_brute(list(before.items()), 200)}
            assert {d: len(before[d].encode()) - len(t.encode()) for d, t in after.items()} == want and want[27] > 200
        elif name == "pii_surrogates":
            assert {d for d in after if after[d] != before[d]} == {32} and "me.too" not in after[32]
        else:
            library = Tokenizer.from_file(vocabulary_path())
            got = Counter()
            for r in docs.collect():
                got[r["doc_id"]] += r["length"]
            assert got == {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in before.items()}


def test_run_over_odd_rows(spark, tmp_path):
    """Rows that share an id, repeated rows, null ids and texts, and a column that no stage knows."""
    rows = corpus()
    one, two, three = rows[0][1], rows[1][1], rows[2][1]
    some = [(1, one, "a"), (1, one, "b"), (1, two, "c"), (2, two + " tail", "d"), (None, three, "e"), (None, three, "f"), (7, None, "g"), (8, "", "h")]
    docs = spark.createDataFrame([(d, t, "en", "s", None, x) for d, t, x in some], f"{SCHEMA}, text_hash string")
    kept = pipeline.near_dedup(spark, docs, None)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] or -1, r["text"] or "") for r in kept.collect())
    # both texts of id 1 stay, each once; 2 is near one of them
    assert got == sorted([(1, one), (1, two), (-1, three), (-1, three), (7, ""), (8, "")])
    docs.write.parquet(f"{tmp_path}/full/documents.parquet")
    found = pipeline.run(spark, f"{tmp_path}/full").collect()
    assert {r["doc_id"] for r in found} == {1, None}
    docs.filter("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0
