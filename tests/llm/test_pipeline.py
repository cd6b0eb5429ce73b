"""The pipeline against brute force, stage by stage, on the smallest tables with planted cases."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lanternfish.llm import token_output

SF = "/root/testdata/sf0.001"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))


@pytest.fixture(scope="module")
def planted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    body = " ".join(f"planted{i} words{i % 13} here{i % 7}" for i in range(80))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 150").orderBy("item_id").first().text
    rows = [(90_001, body, "en", "src0", 1), (90_002, body, "en", "src1", 1), (90_003, body + " tail", "en", "src1", 1), (90_004, item + " and then some", "en", "src2", 1), (90_005, " ".join(f"clean{i} text{i % 11}" for i in range(90)), "en", None, 1)]
    return docs.unionByName(spark.createDataFrame(rows, docs.schema))


def test_stage_list_matches_the_contract(spark):
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_stages_take_effect(spark, planted):
    docs, kept = planted, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == planted.columns, name
        out = out.cache()
        kept.append(out.collect())
        docs = out
    toxic, near, clean, mixed = ({r.doc_id for r in rows} for rows in kept)
    assert 90_005 in mixed or 90_005 in clean
    assert len(toxic) <= planted.count() and {90_001, 90_002, 90_003, 90_004, 90_005} <= toxic
    assert 90_001 in near and not {90_002, 90_003} & near
    assert 90_004 in near and 90_004 not in clean and 90_005 in clean
    texts = [r.text for r in kept[1]]
    assert len(texts) == len(set(texts))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(words, texts)]
    assert not [(i, j) for i in range(len(sets)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    sizes, taken = Counter(), Counter()
    for r in kept[2]:
        sizes[r.source] += len(re.findall(r"[^ \t-\r]+", r.text))
    for r in kept[3]:
        taken[r.source] += len(re.findall(r"[^ \t-\r]+", r.text))
    assert all(n <= 2 * sizes[s] for s, n in taken.items()) and abs(sum(taken.values()) / (1.5 * sum(sizes.values())) - 1) < 0.2
    assert max(Counter(r.doc_id for r in kept[3]).values()) <= 2
    got = sorted(tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect())
    tok, want, start = token_output.tokenizer(str(token_output.vocabulary_path())), [], 0
    for r in sorted(kept[3], key=lambda r: r.doc_id):
        ids = tok.encode(r.text, add_special_tokens=False).ids + [0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want)


def test_run_gives_the_same_rows_twice(spark):
    once, again = (sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) for _ in range(2))
    assert once == again and once
