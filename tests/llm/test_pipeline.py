"""The stages against brute force on a small table with nulls, repeated rows, long texts and clashing columns."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from riskloom.llm import langid, toxicity
from tests.llm.test_minhash import brute
from tests.llm.test_models import plain_toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, KEPT string, language_score string"


def rows():
    rng = random.Random(12)
    parts = {"aa": ["tha", "ing", "the"], "bb": ["eau", "oux", "ché"]}
    out = []
    for i in range(240):
        lang = rng.choice(list(parts))
        words = ["".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(12, 40))]
        if i % 6 == 0:
            words[3] = "vilest"
        out.append((i, " ".join(words), lang if i % 9 else None, "s", 1, "x", None))
    out += [(1000 + i, out[i][1] + (" more" if i % 2 else ""), "aa", "copy", 1, None, "y") for i in range(1, 60)]
    out += [(5, out[5][1], "aa", "a", 2, None, None), (5, out[5][1], "aa", None, 1, None, None), (7, "another the thaing text of the same id and so on", "aa", "b", 1, None, None)]
    out += [(None, out[8][1], "aa", "no id", 1, None, None), (None, out[8][1], "aa", "no id", 1, None, None), (2001, None, "aa", None, None, None, None), (2002, "", None, None, 0, None, None), (2003, "12 34 !!", "bb", None, 8, None, None), (2004, "the thaing " * 9000, "aa", "long", 1, None, None)]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows(), SCHEMA).write.parquet(str(path / "documents.parquet"))
    labels = [(i, 0, int(i % 6 == 0)) for i in range(240)] + [(None, 0, 1), (3, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)



def key(r):
    return [(x is not None, x) for x in r]


def test_every_stage_equals_brute_force(spark, folder):
    now = rows()
    docs = spark.createDataFrame(now, SCHEMA)
    # toxicity
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(cp._remainder(4) != 2)
    machine = toxicity.fit(docs, labels)
    want = [r for r in now if plain_toxicity(machine, r[1]) < cp.TOXIC_FROM]
    got = [tuple(r) for r in cp.drop_toxic(spark, docs, folder).collect()]
    assert sorted(got, key=key) == sorted(want, key=key) and {r[0] for r in now if "vilest" in (r[1] or "")} & {r[0] for r in got} == set()
    # language
    now, docs = got, spark.createDataFrame(got, SCHEMA)
    model = langid.fit(docs.where(cp._remainder(5) != 0))
    said = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in langid.predict(docs.select("doc_id", "text"), model).collect()}
    want = [r for r in now if said[r[0], r[1]][0] != "und" and said[r[0], r[1]][1] >= cp.MIN_LANGUAGE_SCORE]
    got = [tuple(r) for r in cp.drop_unknown_language(spark, docs, folder).collect()]
    assert sorted(got, key=key) == sorted(want, key=key) and not {2001, 2002, 2003} & {r[0] for r in got} and 2004 in {r[0] for r in got}
    # near duplicates: brute force over ids, the texts of an id as nodes of their own tied together
    now, docs = got, spark.createDataFrame(got, SCHEMA)
    nodes = [r for r in now if r[0] is not None]
    parts = brute(list(enumerate(r[1] for r in nodes)))
    root = [parts[n][1] for n in range(len(nodes))]
    for i in {r[0] for r in nodes}:
        mine = {root[n] for n, r in enumerate(nodes) if r[0] == i}
        root = [min(mine) if x in mine else x for x in root]
    least = {}
    for n, r in enumerate(nodes):
        least[root[n]] = min(least.get(root[n], r[0]), r[0])
    stay = {}
    for n, r in enumerate(nodes):
        if least[root[n]] == r[0]:
            order = key((r[1], *r[2:]))
            if r[0] not in stay or order < stay[r[0]][0]:
                stay[r[0]] = (order, r)
    want = [r for _, r in stay.values()] + [r for r in now if r[0] is None]
    got = [tuple(r) for r in cp.drop_near_duplicates(spark, docs, folder).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    # packing
    docs = spark.createDataFrame(got, SCHEMA)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in got:
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r[0], at // 2048, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for at in range(0, len(ids), 2048)]
    packed = cp.pack_documents(spark, docs, folder).collect()
    assert sorted([tuple(r[:5]) for r in packed], key=key) == sorted(want, key=key)
    fill = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048 and len(fill) == -(-sum(r.length for r in packed) // 2048)


def test_stages_on_an_empty_table_and_run(spark, folder):
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in cp.STAGES:
        out = stage(spark, empty, folder)
        assert out.count() == 0 and (name == "packing" or out.columns == empty.columns)
    ids = {r.doc_id for r in cp.run(spark, folder).collect()}
    assert ids and not {2001, 2002, 2003} & ids and 1002 not in ids
