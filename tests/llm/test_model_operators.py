"""Toxicity, quotation links and the pipeline."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from cadenza.llm import byte_bpe, decontaminate, quote_links, weak_toxicity

from .conftest import frame, prose


@pytest.fixture(scope="module")
def labelled():
    """Clean prose, toxic prose with lexicon words, and toxic prose with a stem that only labels tell."""
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(400):
        words = prose(rng, rng.randint(5, 120)).split()
        toxic = k % 4 == 0
        if toxic:
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randint(0, len(words)), rng.choice(["Moron", "trash,", "scum"]) if k % 8 else "zorgl" + rng.choice(["ta", "ri", "mu"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return rows, labels


def test_toxicity_on_the_held_out_fold(spark, labelled):
    rows, labels = labelled
    truth = dict(labels)
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in weak_toxicity.toxicity(frame(spark, rows), table).collect()}
    assert len(got) == len(rows)
    held = [k for k in got if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(got[k].held_out == (k in set(held)) for k in got)
    assert all((r.score >= 0.7) == (r.predicted == 1) and 0 <= r.score <= 1 for r in got.values())
    right = np.mean([got[k].predicted == truth[k] for k in held])
    assert right > 0.97
    # the fold's labels are not read: turned around, they change nothing
    turned = spark.createDataFrame([(k, 1 - y if k in set(held) else y) for k, y in labels], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in weak_toxicity.toxicity(frame(spark, rows), turned).collect()}
    assert all(again[k] == pytest.approx(got[k].score, abs=1e-9) for k in got)


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (11, 1), (11, 1), (2, None), (None, 1), (999, 1), (5, 0), (5, 1)], "doc_id long, toxic int")
    got = weak_toxicity.toxicity(odd, labels).collect()
    assert len(got) == odd.count() and all(r.score is not None for r in got)
    nobody = spark.createDataFrame([], "doc_id long, toxic int")
    scores = {r.doc_id: r.score for r in weak_toxicity.toxicity(odd, nobody).collect()}
    assert scores[11] > scores[1]
    assert weak_toxicity.toxicity(none, labels).count() == 0


def test_toxicity_bounds(spark, labelled):
    """A word of one sampled toxic text is a feature only if that is asked for."""
    rows, labels = labelled
    learned = [k for k in range(1000, 1020) if zlib.crc32(str(k).encode()) % 3 != 1][0]
    own = [*rows, (learned, "moron qqxyz trash"), (2000, "qqxyz"), (2001, "")]
    table = spark.createDataFrame([*labels, (learned, 1)], "doc_id long, toxic int")
    plain = {r.doc_id: r.score for r in weak_toxicity.toxicity(frame(spark, own), table).collect()}
    wide = {r.doc_id: r.score for r in weak_toxicity.toxicity(frame(spark, own), table, least_texts=1, most_voters=20).collect()}
    assert plain[2000] == plain[2001] and wide[2000] > wide[2001]
    few = {r.doc_id: r.score for r in weak_toxicity.toxicity(frame(spark, own), table, least_texts=1, most_features=len(weak_toxicity.LEXICON)).collect()}
    assert few[2000] == few[2001]


def test_label_model_shares_weight_between_copies():
    """Of three voters two always vote alike: EM gives each of them about half a vote."""
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.3
    a, b = (rng.random(y.shape) < np.where(y, 0.6, 0.05) for _ in range(2))
    votes = np.stack([a, a, b], axis=1).astype(float)
    model = weak_toxicity.LabelModel(0.3, np.array([[0.05] * 3, [0.5] * 3]))
    known = np.stack([weak_toxicity._sums(votes[:500], (y[:500] == c).astype(float)) for c in (0, 1)])
    for _ in range(30):
        p = model.posterior(votes)
        model.update(np.stack([weak_toxicity._sums(votes, 1 - p), weak_toxicity._sums(votes, p)]) + known)
    assert model.correlation[0, 1] > 0.7 > 0.3 > abs(model.correlation[0, 2])
    weight = 1 / (1 + np.clip(model.correlation, 0, 1).sum(axis=1))
    assert weight[0] + weight[1] < 1.3 * weight[2]
    both = np.array([[1.0, 1, 0]])
    shared = model.posterior(both)[0]
    model.correlation[:] = 0
    assert shared < model.posterior(both)[0]


# ---- quotation links

TALK = [
    (1, 0, "Shall we meet?\nThe hall is free."),
    (1, 1, "> Shall we  MEET?\nYes, on Monday."),
    (1, 2, "On Monday, A wrote:\n>> Shall we meet?\n>> The hall is free.\n> Yes, on Monday.\nGood."),
    (1, 3, "> unknown words\nHm."),
    (1, 4, "> Good.\nFine then."),
    (2, 0, "> The hall is free.\nWhich hall?"),
    (2, 1, "> later text"),
    (2, 2, "later text"),
    (3, 0, None),
    (3, 1, ""),
    (3, 1, ">\n> \n"),
    (None, 0, "> Good."),
]


def test_quote_links(spark):
    df = spark.createDataFrame([(*r, "user", "x", "y") for r in TALK], "conv_id long, turn long, text string, role string, hash string, clean string")
    got = {(r.conv_id, r.turn, r.clean): r for r in quote_links.linked_conversations(df).collect()}
    assert len(got) == len(TALK) - 1  # the two empty rows of turn (3, 1) read alike
    r = got[1, 1, "Yes, on Monday."]
    assert (r.parent_turn, r.root_turn, r.reply_depth, r.n_quotes, r.n_linked) == (0, 0, 1, 1, 1)
    r = got[1, 2, "Good."]
    assert [(x.depth, x.to_conv, x.to_turn) for x in r.links] == [(2, 1, 0), (1, 1, 1)]
    assert (r.parent_turn, r.root_turn, r.reply_depth) == (1, 0, 2)
    assert got[1, 4, "Fine then."].reply_depth == 3
    r = got[1, 3, "Hm."]
    assert (r.n_quotes, r.n_linked, r.parent_turn, r.root_turn) == (1, 0, None, 3)
    r = got[2, 0, "Which hall?"]
    assert [(x.to_conv, x.to_turn) for x in r.links] == [(1, 0)] and r.parent_turn is None
    assert got[2, 1, ""].n_linked == 0
    assert got[None, 0, ""].n_quotes == 1


def test_quotes_link_to_the_latest_earlier_turn(spark, monkeypatch):
    """Against brute force, over several blocks of turns."""
    monkeypatch.setattr(quote_links, "TURNS", 4)
    rng = random.Random(1)
    rows, said = [], {}
    for t in range(120):
        text = rng.choice(["yes", "no", "maybe"])
        quoted = rng.choice(["yes", "no", "maybe", "never"])
        rows.append((1, t, f"> {quoted}\n{text}", said.get(quoted)))
        said[text] = t
    df = spark.createDataFrame([r[:3] for r in rows], "conv_id long, turn long, text string")
    got = {r.turn: r.parent_turn for r in quote_links.linked_conversations(df).collect()}
    assert got == {r[1]: r[3] for r in rows}


def test_quotes_link_elsewhere(spark):
    """Against brute force, over several conversations: the own one may be the first that says a line, but later."""
    rng = random.Random(3)
    rows = [(0, 0, "> X"), (0, 1, "X"), (2, 0, "X"), (None, 0, "> X"), (4, 0, "> only\nonly")]
    for c in range(5, 17):
        for t in range(4):
            quoted, text = (rng.choice([f"line {k}" for k in range(14)]) for _ in range(2))
            rows.append((c, t, f"> {quoted}\n{text}"))
    said = [(c, t, own) for c, t, text in rows if c is not None and (own := text.split("\n")[-1])[0] != ">"]
    want = {}
    for c, t, text in rows:
        if text[0] != ">":
            continue
        quoted = text.split("\n")[0][2:]
        here = [(a, b) for a, b, x in said if x == quoted and a == c and b < t]
        elsewhere = [(a, b) for a, b, x in said if x == quoted and a != c and c is not None]
        want[c, t] = [max(here)] if here else [min(elsewhere)] if elsewhere else []
    got = {(r.conv_id, r.turn): [(x.to_conv, x.to_turn) for x in r.links] for r in quote_links.linked_conversations(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert want[0, 0] == [(2, 0)] and want[4, 0] == []
    assert {k: got[k] for k in want} == want


def test_no_messages(spark):
    assert quote_links.linked_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---- pipeline


def test_pipeline(spark, labelled, odd_rows, tmp_path):
    """Each stage against brute force on what the one before it kept."""
    rows, labels = labelled
    rng = random.Random(9)
    item = prose(rng, 30)
    base = prose(rng, 80)
    extra = [(1000, base), (1001, base + " end"), (1002, base), (1003, prose(rng, 20) + " " + item + " " + prose(rng, 20)), (1004, "the password: 12345678 is é old"), (1005, None), (1006, "")]
    own = rows + extra
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in own], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    toxic = dict(labels)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS
        path = f"{tmp_path}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {r.doc_id: r for r in docs.collect()}
    first = kept["toxicity"]
    assert sum(k in first for k, y in toxic.items() if y) <= 3 and all(k in first for k, y in toxic.items() if not y) and all(k in first for k, _ in extra)
    gone = set(first) - set(kept["near_duplicates"])
    assert gone == {1001, 1002}
    assert set(kept["near_duplicates"]) - set(kept["decontamination"]) == {1003}
    assert kept["secrets"][1004].text == "the  is é old" and kept["secrets"][1004].n_chars == len("the  is é old")
    assert {k: r.text for k, r in kept["secrets"].items() if k != 1004} == {k: r.text for k, r in kept["decontamination"].items() if k != 1004}
    last = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(last) == set(kept["secrets"])
    import public_tokenizers as P

    codec = byte_bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert all(codec.decode(r.ids) == (kept["secrets"][k].text or "").encode() for k, r in last.items())


def test_pipeline_decides_by_row(spark, labelled, tmp_path):
    """Rows without a key, and rows of one key with unlike texts, in every stage."""
    rows, labels = labelled
    rng = random.Random(10)
    item, base = prose(rng, 30), prose(rng, 80)
    leak, other = (prose(rng, 20) + " " + item + " " + prose(rng, 20) for _ in range(2))
    toxic = prose(rng, 10) + " moron trash, scum " + prose(rng, 10)
    clean = [prose(rng, 40) for _ in range(8)]
    # copies of a kept text go, under null keys, repeated ones and keys that belong to another group too
    extra = [(None, clean[0]), (None, clean[1]), (1000, clean[2]), (1000, clean[3]), (1000, clean[3]), (1001, base), (1002, base + " end"), (1002, clean[4]), (None, base + " tail"), (None, "")]
    extra += [(None, toxic), (1003, toxic + " zu"), (1003, clean[5]), (None, leak), (1004, other), (1004, clean[6])]
    extra += [(None, "the password: 12345678 is old"), (1005, "password: 87654321"), (1005, clean[7])]
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows + extra], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, own, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), set(range(400)), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = sorted([(r.doc_id or 0, r.text) for r in docs.collect() if r.doc_id not in own])
    want = [(k or 0, t) for k, t in extra if toxic not in t]
    assert kept["toxicity"] == sorted(want)
    want.remove((1000, clean[3]))
    want = [x for x in want if x not in ((1002, base + " end"), (0, base + " tail"))]
    both = [(0, leak), (1004, other)]
    assert kept["near_duplicates"] == sorted(want)
    want = [x for x in want if x not in both]
    assert kept["decontamination"] == sorted(want)
    cut = {"the password: 12345678 is old": "the  is old", "password: 87654321": ""}
    assert kept["secrets"] == sorted((k, cut.get(t, t)) for k, t in want)
    assert sorted((r.doc_id or 0) for r in corpus_pipeline.run(spark, str(tmp_path)).collect() if r.doc_id not in own) == sorted(k for k, _ in want)


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_block_items(spark):
    items = spark.createDataFrame([(k, f"w{k} x{k} y{k}") for k in range(20)], "item_id long, text string")
    assert sum(len(b) for b in decontaminate.item_blocks(items, "item_id", "text", 10, 6)) == 20
