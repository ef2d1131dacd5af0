import hashlib
import random

import numpy as np

from riskloom.llm import chat, langid, licenses, toxicity
from riskloom.llm.licenses import BASE, Index, Template, words_of


def brute_licenses(words, templates):
    """Places of phrases, and (template, first word, last word, most shared) of each run of blocks, from every block."""
    out = set()
    for k, t in enumerate(templates):
        w = words_of(t.text)
        if t.ordered:
            out |= {(k, i, i + len(w), 1.0) for i in range(len(words)) if words[i : i + len(w)] == w}
            continue
        reach, need, run = max(1, int(licenses.REACH * len(w))), max(1, -int(-len(set(w)) * t.threshold // 1)), []
        for b in range(len(words) + 1):
            block = words[b : b + reach] if b < len(words) else []
            if len(set(block) & set(w)) >= need:
                run.append(b)
            elif run:
                held = [i for i in range(run[0], min(len(words), run[-1] + reach)) if words[i] in w]
                best = max(len(set(words[b : b + reach]) & set(w)) for b in run)
                out.add((k, held[0], held[-1] + 1, best / len(set(w))))
                run = []
    return sorted(out)


def test_license_join_equals_brute_force():
    rng = random.Random(5)
    templates = (*BASE, Template("x", "a b c d e f g h", 0.75), Template("y", "all all rights cc", 0.6), Template("z", "a a a", ordered=True), Template("x again", "h g f e d c b a", 0.75), Template("none", "", 0.5))
    vocabulary = words_of("a b c d e f g h cc by general public license all rights reserved q r s t u v w")
    for n in (0, 1, 5, 9, 10, 64, 400):
        for _ in range(25):
            words = [rng.choice(vocabulary[: rng.choice([8, 23])]) for _ in range(n)]
            counts = {w: rng.randint(0, 9) for t in templates for w in words_of(t.text)}
            assert Index(templates, counts).matches(words) == brute_licenses(words, templates)


def test_license_texts_are_found_whole():
    templates = licenses.BASE + licenses.SENTENCES + licenses.TEXTS
    index = Index(templates, {w: len(w) for t in templates for w in words_of(t.text)})
    rng = random.Random(7)
    for k, t in enumerate(templates):
        if t in licenses.TEXTS:
            text = words_of(t.text)
            for share, found in ((0, True), (8, True), (3, False)):  # every so many words another one
                changed = [b"other%d" % i if share and i % share == 0 else w for i, w in enumerate(text)]
                lead = [b"lead%d" % rng.randrange(99) for _ in range(rng.randrange(400))]
                got = [m for m in index.matches(lead + changed + lead) if m[0] == k]
                assert bool(got) == found, (t.label, share)
                if not share:
                    assert got == [(k, len(lead), len(lead) + len(text), 1.0)]


def test_license_query_equals_brute_force(spark, tmp_path):
    from riskloom.llm.queries import op5_licenses

    mit = licenses.TEXTS[0].text
    rows = [(1, None), (2, ""), (3, "CC-BY; all Rights reserved. cc by"), (4, "x " * 9000 + "GENERAL public License"), (4, f"intro {mit} cc by"), (5, "émission cc\tby"), (None, "all rights reserved")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    templates = licenses.BASE + licenses.SENTENCES + licenses.TEXTS
    want = []
    for i, t in rows:
        words = words_of(t or "")
        found = brute_licenses(words[-400:], templates) if len(words) > 8000 else brute_licenses(words, templates)
        shift = max(0, len(words) - 400) if len(words) > 8000 else 0
        starts = [a + shift for k, a, _, _ in found if templates[k].ordered]
        names = lambda ordered: ",".join(sorted({templates[k].label for k, *_ in found if templates[k].ordered or not ordered}))
        want.append((i, len(words), len(starts), min(starts, default=None), max(starts, default=None), names(True), names(False), max((c for *_, c in found), default=0.0)))
    got = [tuple(r) for r in op5_licenses(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert ("mit-text" in got[0][6]) + sum("mit-text" in r[6] for r in got[1:]) == 1
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert op5_licenses(spark, str(tmp_path / "none")).count() == 0


def test_license_operator(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "CC-BY; all Rights reserved. cc by", None), (3, "x " * 30000 + "GENERAL public License", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_WORDS string")
    got = {(r.doc_id, r.n_words): sorted((m.label, m.start) for m in r.matches) for r in licenses.scan(df).collect()}
    assert got == {(1, 0): [], (2, 0): [], (3, 7): [("cc-by", 0), ("cc-by", 5), ("reserved", 2)], (3, 30003): [("gpl", 30000)]}
    assert licenses.scan(df.limit(0)).count() == 0 and licenses.scan(df.limit(0), (Template("own", "p q r", 0.5),)).count() == 0


def test_machine_learns_an_interaction():
    rng = np.random.default_rng(3)
    terms, labels = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.4
        terms.append(np.array([*([11] if a else []), *([22] if b else []), 1000 + rng.integers(0, 500)]))
        labels.append(float(a and b))
    machine = toxicity.fit_machine(terms, np.array(labels))
    p = lambda *t: machine.score(np.array([machine.place[x] for x in t], np.int64), np.zeros(len(t), np.int64), 1)[0]
    assert p(11, 22) > 0.7 > 0.3 > max(p(11), p(22), p())
    assert abs(machine.factors[machine.place[11]] @ machine.factors[machine.place[22]]) > 0.1


def test_toxicity_operator(spark):
    rng = random.Random(1)
    words = [f"plain{k}" for k in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=20) + (["vile"] if i % 5 == 0 else [])), "z") for i in range(400)] + [(9001, None, None), (9002, "", None), (9002, "vile " * 9000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Score string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(5, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.score(df, toxicity.fit(df, labels)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.score >= 0.3) == ("vile" in (r.text or "")) and 0 <= r.score <= 1
    none = toxicity.fit(df, labels.limit(0))
    assert {r.score for r in toxicity.score(df, none).collect()} == {toxicity.score(df, none).first().score}
    assert toxicity.score(df.limit(0), none).count() == 0


def test_language_operator(spark):
    rng = random.Random(2)
    parts = {"aa": ["tha", "ing", "the"], "bb": ["eau", "oux", "ché"], "cc": ["sch", "ung", "ein"]}
    make = lambda name: " ".join("".join(rng.choices(parts[name], k=rng.randint(1, 4))) for _ in range(30))
    rows = [(i, make(name), name, "x") for i, name in enumerate(random.Random(3).choices(list(parts), k=600))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, Lang_Pred string")
    model = langid.fit(df.where("doc_id % 5 <> 0"))
    odd = spark.createDataFrame([(-1, None, None, None), (-2, "", None, None), (-3, "12 !? _ ²", None, None), (-4, "THE " * 40000, None, None)], df.schema)
    got = {r.doc_id: r for r in langid.predict(df.unionByName(odd), model).collect()}
    assert np.mean([got[i].lang_pred == name for i, _, name, _ in rows if i % 5 == 0]) > 0.97
    assert [got[-k].lang_pred for k in (1, 2, 3, 4)] == ["und", "und", "und", "aa"] and got[-1].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(df.limit(0))).collect()} == {"und"}


def test_calibration_finds_the_temperature():
    rng = np.random.default_rng(0)
    z = rng.normal(0, 1, (20000, 3))
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    y = np.array([rng.choice(3, p=x) for x in p])
    assert abs(langid.calibrate(z * 3, y) - 3) < 0.2


def test_chat_round_trip_and_parts(spark):
    texts = ["plain", r"\### Assistant: </turn> ok", "a\\h\\\\l<b>#:\n", None, "", "### user: x</turn>\n" * 300, "\U0001f600é"]
    rows = [(1, k, ["user", "assistant", "we:ird<#"][k % 3], t, "extra") for k, t in enumerate(texts)] + [(2, 0, None, "x", None), (2, 0, None, "x", None), (None, 1, "assistant", "n", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, Formatted string")
    df = df.withColumn("content", chat.text_part(df["text"]))
    out = chat.format_conversations(df)
    back = {r.conv_id: r for r in out.select("conv_id", chat.parse(out["formatted"]).alias("turns"), chat.loss_text(out["formatted"], out["loss_spans"]).alias("loss")).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [(r, t or "") for _, _, r, t, _ in rows[:7]]
    assert back[1].loss == "".join(t or "" for _, _, r, t, _ in rows[:7] if r == "assistant")
    assert len(back[2].turns) == 2 and back[None].loss == "n"
    assert chat.format_conversations(df.limit(0)).count() == 0
    parts = spark.sql("SELECT 1L conv_id, 0L turn, 'user' role, array(named_struct('type','text','text','see <image:1>','ref',null,'units',null), named_struct('type','image','text',null,'ref','a.png','units',2L), named_struct('type',null,'text',null,'ref','q','units',1L)) content UNION ALL SELECT 1L, 1L, 'assistant', array(named_struct('type','audio','text',null,'ref','b.wav','units',4L), named_struct('type','text','text','ok','ref',null,'units',null))")
    r = chat.format_conversations(parts).first()
    assert [(a["index"], a.type, a.ref, a.tokens) for a in r.attachments] == [(1, "image", "a.png", 85 + 340), (2, "file", "q", 0), (3, "audio", "b.wav", 100)]
    assert "<image:1><file:2></turn>" in r.formatted and "see \\limage:1>" in r.formatted and r.attachment_tokens == 525
    assert hashlib.sha256(r.formatted.encode()).hexdigest()


def test_license_templates_in_batches_give_the_same_matches(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(30)]
    templates = tuple(Template(f"t{k}", " ".join(rng.choices(words, k=rng.randint(1, 12))), rng.choice([0.5, 0.8, 1.0]), rng.random() < 0.4) for k in range(25))
    assert [t for batch in licenses.batches_of(templates, 20) for t in batch] == list(templates) and len(licenses.batches_of(templates, 20)) > 5
    assert licenses.batches_of((), 5) == [()] and [len(b) for b in licenses.batches_of(templates, 1)] == [1] * 25
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 200))), "own") for k in range(40)] + [(40, None, "x"), (41, "", None), (5, "w1 w2 w3", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Matches string")
    said = lambda found: sorted((r.doc_id, r.n_words, [tuple(m) for m in r.matches]) for r in found.collect())
    want = said(licenses.scan(df, templates))
    assert sum(len(m) for _, _, m in want) > 50
    for size in (20, 1000):
        for keep in (None, ["doc_id"]):
            got = licenses.scan(df, templates, keep=keep, batch_words=size)
            assert said(got) == want and got.columns == (["doc_id", "text"] if keep is None else keep) + ["n_words", "matches"]
    shown = df.select("doc_id", "text").withColumnRenamed("text", "matches")
    assert said(licenses.scan(shown, templates, text_col="matches", batch_words=20)) == want
