"""Every stage on what its predecessor kept, against brute force."""

import re

from test_bpe import PATH
from test_decontam import words as item_words
from test_minhash import brute as groups
from test_substring import WORD, brute as windows
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tessera.llm import quality


def benchmark_hits(text, windows_of_ten):
    w = item_words(text)
    hit = set()
    for i in range(len(w)):
        for k in {len(x) for x in windows_of_ten}:
            if tuple(w[i : i + k]) in windows_of_ten:
                hit.update(range(i, i + k))
    return [x for k, x in enumerate(w) if k not in hit]


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, []
    for i, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(cp.STAGES) - 1:
            assert after.columns == columns
        kept.append(({r["doc_id"]: r.asDict() for r in docs.collect()}, {r["doc_id"]: r.asDict() for r in after.collect()}))
        docs = after

    before, after = kept[0]
    verdicts = {r["doc_id"]: r["kept"] for r in quality.quality(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert set(after) == {d for d, k in verdicts.items() if k} and all(after[d] == before[d] for d in after)

    before, after = kept[1]
    assert set(after) == {r[0] for r in groups([(d, r["text"]) for d, r in before.items()], width=5) if r[3]}
    assert all(after[d] == before[d] for d in after)

    before, after = kept[2]
    want = {r[0]: r[2] for r in windows([(d, r["text"]) for d, r in before.items()], 35)}
    assert set(after) == set(before)
    for d, r in before.items():
        assert len(WORD.findall(r["text"])) - len(WORD.findall(after[d]["text"])) == want[d]
        assert after[d]["n_chars"] == len(after[d]["text"])
        if not want[d]:
            assert after[d] == r

    before, after = kept[3]
    items = {tuple(w[i : i + min(10, len(w))]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if (w := item_words(r["text"])) for i in range(len(w) - min(10, len(w)) + 1)}
    assert set(after) == set(before)
    for d, r in before.items():
        assert item_words(after[d]["text"]) == benchmark_hits(r["text"], items)

    before, after = kept[4]
    library = Tokenizer.from_file(PATH)
    assert set(after) == set(before)
    for d, r in before.items():
        assert after[d]["ids"] == library.encode(r["text"], add_special_tokens=False).ids and after[d]["text"] == r["text"]


def test_empty_and_odd_documents(spark, sf):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 40, None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for d in (docs, docs.limit(0)):
        for _, stage in cp.STAGES:
            assert stage(spark, d, sf).count() <= 4


def test_stage_order():
    assert len(cp.STAGES) == 5 and re.match("quality", cp.STAGES[0][0])
