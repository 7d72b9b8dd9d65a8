import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import abuse, leakage, packing, residue

WORDS = [f"w{i}" for i in range(4000)]


def _text(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def test_leaks(spark):
    rnd = random.Random(5)
    items = [(i, _text(rnd, 80), "q") for i in range(6)] + [(90, None, "q"), (91, "", "q"), (92, "too short", "q")]
    part = lambda i, a, b: items[i][1].split()[a:b]
    edited = part(1, 0, 70)
    for k in (9, 21, 35, 50):
        edited[k] = "changed"
    del edited[60]
    edited.insert(15, "extra")
    noise = lambda n: _text(rnd, n).upper()
    docs = [
        (1, noise(50) + " " + items[0][1].upper() + ". " + noise(40)), (2, noise(30) + " " + " ".join(edited) + " " + noise(30)),
        (3, " ".join(part(2, 0, 20)) + " " + noise(60) + " " + " ".join(part(2, 50, 75)) + " " + noise(9)), (4, noise(20) + " " + " ".join(part(3, 10, 24)) + " " + noise(20)),
        (5, None), (6, ""), (7, noise(60_000) + " " + items[4][1]), (7, "again"), (8, items[5][1]), (8, items[5][1]), (9, noise(400)),
    ]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id bigint, text string, share string")
    got = sorted((r.doc_id, r.item_id) for r in leakage.find_leaks(df, spark.createDataFrame(items, "item_id bigint, text string, share string")).collect())
    assert got == [(1, 0), (2, 1), (3, 2), (7, 4), (8, 5)]
    blocks = leakage.BLOCK_WORDS
    try:
        leakage.BLOCK_WORDS = 100
        more = sorted((r.doc_id, r.item_id) for r in leakage.find_leaks(df, spark.createDataFrame(items, "item_id bigint, text string, share string")).collect())
    finally:
        leakage.BLOCK_WORDS = blocks
    assert more == got
    assert leakage.find_leaks(df.where("false"), spark.createDataFrame(items, "item_id bigint, text string, share string")).count() == 0


def test_leaks_in_another_order(spark):
    """Parts of an item count in whatever order a document holds them, edits included."""
    rnd = random.Random(12)
    items = [(i, _text(rnd, 80)) for i in range(5)]
    part = lambda i, a, b: items[i][1].split()[a:b]
    edit = lambda w: [*w[:6], "changed", *w[7:13], "extra", *w[13:]]
    docs = [
        (1, [*part(0, 60, 80), *part(0, 40, 60), *part(0, 20, 40), *part(0, 0, 20)]),
        (2, [*_text(rnd, 30).split(), *edit(part(1, 50, 68)), *_text(rnd, 12).split(), *edit(part(1, 10, 28)), *_text(rnd, 30).split()]),
        (3, [*part(2, 60, 70), *_text(rnd, 5).split(), *part(2, 10, 20), *_text(rnd, 40).split()]),
        (4, [w for k in range(0, 80, 4) for w in part(3, 76 - k, 80 - k)]),
    ]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.share for r in leakage.find_leaks(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert set(got) == {(1, 0), (2, 1)}  # a quarter of item 2, and phrases of item 3, are no case
    assert got[1, 0] > 0.95


def test_residue(spark):
    own = ["We build sensors for farms in the north.", "The team grew to forty people last year.", "Customers renew after nine months on average.", "The advisory board meets twice a year.", "Pilots showed that losses fell by ten percent."]
    bad = ["404 Not Found The requested URL was not found on this server.", "Welcome to {{company_name}}, the leading maker of {{product}}.", "Please enable JavaScript to continue.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit."]
    rnd = random.Random(2)
    rows = []
    for i in range(400):
        if i % 4 == 0:
            text, status = " ".join([*rnd.sample(bad, 2), *rnd.sample(own, i % 8 == 0)]), rnd.choice(["200", "404"])
        else:
            text, status = " ".join(rnd.sample(own, 5) + ([bad[2]] if i % 11 == 0 else [])), "200"
        rows.append((i, text, status, f"h{i % 50}", "clash"))
    rows += [(900, None, "200", "h", ""), (901, "  ", None, None, ""), (902, "x" * 200_000, "200", "h", ""), (903, bad[0], None, None, "")]
    df = spark.createDataFrame(rows, "page_id bigint, full_text string, statuscode string, domain_clean string, text string")
    got = residue.score_pages(df, residue.train(df)).where("residue")
    want = {i for i in range(0, 400, 4)} | {903}
    assert {r.page_id for r in got.collect()} == want
    held = got.where("fold = 0").count()
    assert held > 0  # right on hosts that it was not fitted to, too
    assert residue.score_pages(df.where("false"), residue.train(df.where("false"))).count() == 0


def test_hashes_use_the_whole_range():
    at = np.concatenate([residue.features(chr(97 + i % 26) * (1 + i // 26 % 26) + chr(97 + i // 676), False, "")[0] for i in range(10_000)])
    at = set(at[at >= 32].tolist())
    assert len(at) > 9_000 and max(at) < 1 << residue.BITS


def test_undisguise():
    assert [abuse.undisguise(w) for w in ("c0nn@rd,", "$w1n3:", "youuu", "m3rd3.", "42", "42%", "Fine!")] == ["connard", "swine", "you", "merde", "0", "0", "fine"]
    assert abuse.words_of("you f i l t h y crook") == ["you", "filthy", "crook"]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 200))
def test_windows_hold_every_word(n):
    w = abuse.windows(list(range(1, n + 1)))
    assert set(w.ravel().tolist()) - {0} == set(range(1, n + 1))
    assert all((a[abuse.STRIDE :] == b[: -abuse.STRIDE]).all() for a, b in zip(w, w[1:]))


def test_gradients():
    """The written-out gradient against differences."""
    abuse_lex = abuse.Lexicon()
    win = np.concatenate([abuse.windows(abuse_lex.rows(t.split())) for t in ("a b c d", "e f g a b", "h")])
    y, w = np.array([1, 0, 1], np.float32), np.ones(3, np.float32)

    def loss(net):
        x, _, _ = net.embed(np.array(abuse_lex.word), abuse_lex.grams)
        q = 1 / (1 + np.exp(-net.forward(net.project(x), win).astype(float)))
        return -(y * np.log(q) + (1 - y) * np.log(1 - q)).mean()

    rate, abuse.RATE = abuse.RATE, 0.0
    try:
        net = abuse.Net(1)
        net.step(abuse_lex, win, y, w)
        for k, at in (("Uf", (3, 5)), ("Wb", (2, 50)), ("v", (4,)), ("Bf", (1,)), ("w", (2,))):
            g, eps = net.m[k][at] / 0.1, 1e-2
            net.p[k][at] += eps
            hi = loss(net)
            net.p[k][at] -= 2 * eps
            lo = loss(net)
            net.p[k][at] += eps
            assert g == pytest.approx((hi - lo) / (2 * eps), abs=2e-4)
    finally:
        abuse.RATE = rate


def test_abuse_held_out(spark):
    rnd = random.Random(8)
    nice = ["tried the pump last week", "any plans for a portable version", "support answered the same day", "the demo crashed twice", "pricing is steep for charities", "the word filth appears in a novel we review"]
    vile = ["shut up you filthy crook", "you deserve a beating worthless cretin", "they are vermin and should be thrown out", "nobody wants your rotten garbage you fraud"]
    docs, labels = [], []
    for i in range(700):
        bad = i % 5 == 0
        s = [rnd.choice(nice) for _ in range(rnd.randint(2, 8))]
        if bad:
            s.insert(rnd.randrange(len(s)), rnd.choice(vile).replace("i", "1" if i % 10 else "i"))
        docs.append((i, ". ".join(s), "src", 0))
        if i < 500:
            labels += [(i, f"r{k}", int(bad) ^ (rnd.random() < 0.03), None) for k in range(3)]
    docs += [(900, None, None, 0), (901, "", None, 0), (902, "word " * 30_000, "src", 0)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, score int")
    lab = spark.createDataFrame(labels + labels[:5], "doc_id bigint, rater string, abusive int, rated_at timestamp")
    net, threshold, stats = abuse.train(d, lab)
    got = {r.doc_id: r.score >= threshold for r in abuse.score(d, net).collect()}
    assert len(got) == 703 and not got[900] and not got[901]
    held = [(i % 5 == 0, got[i]) for i in range(500, 700)]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert abuse.score(d.where("false"), net).count() == 0
    none, t, _ = abuse.train(d, lab.where("false"))
    assert abuse.score(d, none).where(f"score >= {t}").count() == 0


def test_wrong_labels_are_not_learnt_by_heart():
    """Names that occur only in mislabelled documents don't become signs of abuse; and few labels never tune their own threshold."""
    rnd = random.Random(2)
    name = lambda: "".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(4))
    nice = lambda: f"{name()} {name()} builds a quiet pump that helps nurses plan routes in {name()} every week"
    texts, y, truth = [], [], []
    for i in range(400):
        bad = i % 4 == 0
        texts.append(nice() + (". You filthy worthless crook, " + name() if bad else ". Nice work, " + name()) + ". " + nice())
        truth.append(int(bad))
        y.append(int(bad) ^ (i % 19 == 0))
    y, truth = np.array(y), np.array(truth)
    held = np.arange(400) % 5 == 0
    net, threshold, _ = abuse.train_model(texts, y, held)
    got = abuse.Scorer(net).texts(texts) >= threshold
    assert (got == (truth == 1)).mean() > 0.95
    wrong = (y == 1) & (truth == 0) & ~held
    assert wrong.sum() > 10 and got[wrong].sum() <= 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=40))
def test_best_fit(sizes):
    sizes = np.array(sizes)
    where, free = packing.best_fit(sizes, 30)
    used = np.bincount(where, weights=sizes, minlength=len(free))
    assert (used + free == 30).all() and (free >= 0).all()
    assert packing.lower_bound(sizes, 30) <= len(free) <= 1.5 * packing.lower_bound(sizes, 30) + 1


def test_bounds_from_counts():
    rnd = np.random.default_rng(3)
    for _ in range(30):
        sizes = rnd.integers(1, 40, rnd.integers(1, 200))
        value, n = np.unique(sizes, return_counts=True)
        assert packing.lower_bound(value, 40, n) == packing.lower_bound(sizes, 40)


def test_pack_round_trip(spark):
    rnd = random.Random(3)
    sizes = {i: rnd.choice([3, 40, 99, 100, 101, 250, 1000]) + rnd.randrange(5) for i in range(300)}
    df = spark.createDataFrame([*sizes.items(), (900, 0)], "id bigint, n int").where("n > 0")
    placed, bounds = packing.pack(df, {1: 100, 2: 512}, part_items=100)
    rows = placed.collect()
    for c, cap in ((1, 100), (2, 512)):
        mine = [r for r in rows if r.capacity_id == c]
        by = {}
        for r in mine:
            by.setdefault(r.id, []).append((r.start, r.size))
        for i, n in sizes.items():
            at = 0
            for start, size in sorted(by[i]):
                assert start == at
                at += size
            assert at == n and (len(by[i]) == 1 or n > cap)
        box = {}
        for r in mine:
            box.setdefault(r.container, []).append(r)
        assert all(sum(r.size for r in b) <= cap and sorted(r.position for r in b) == list(range(1, len(b) + 1)) for b in box.values())
        b = next(x for x in bounds.collect() if x.capacity_id == c)
        assert b.containers == len(box) == max(box) and b.least <= len(box) <= b.least + 0.02 * b.least + 2
    empty, _ = packing.pack(df.where("false"), {1: 100})
    assert empty.count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "ä" * 3), (5, "word " * 50_000)], "doc_id bigint, text string")
    n = {r.id: r.n for r in packing.count_tokens(df).collect()}
    enc = packing.encoder(packing.TOKENIZER)
    assert set(n) == {1, 4, 5} and n[1] == len(enc.encode_ordinary("Hello world")) == 2


def test_seeds():
    assert all(residue.seeded(x) for x in ("Oh: 502 Bad Gateway","by [Founder Name] in", "in __CITY_NAME__", "Hi {{x}}", "NOT FOUND", "Lorem ipsum"))
    assert not residue.seeded("We forecast 502 losses for [old] mills.")


def test_residue_in_unseen_words(spark):
    """Wordings that no seed matches are learnt from the pages that they share with known ones, and found on hosts held out."""
    own = [f"Our {a} helps {b} to {c} every week." for a in ("sensor", "pump", "ledger", "drone") for b in ("farms", "mills", "ports") for c in ("plan routes", "cut waste", "track orders")]
    new = ["Oops, this address has wandered off.", "Kindly return to where you came from.", "Nothing lives here any more, sadly."]
    assert not any(residue.seeded(x) for x in new)
    rnd, rows = random.Random(3), []
    for i in range(600):
        kind = i % 6
        text = " ".join(rnd.sample(own, 5)) if kind > 1 else " ".join([*rnd.sample(new, 1 + kind), *["404 Not Found."] * (kind == 0)])
        rows.append((i, text, "404" if kind == 0 else "200", f"h{i % 97}"))
    df = spark.createDataFrame(rows, "page_id bigint, full_text string, statuscode string, domain_clean string")
    scored = residue.score_pages(df, residue.train(df), weak=True)
    got = {r.page_id: (r.residue, r.fold) for r in scored.collect()}
    assert {i for i, (bad, _) in got.items() if bad} == {i for i in range(600) if i % 6 < 2}
    assert any(bad and fold == 0 and i % 6 == 1 for i, (bad, fold) in got.items())
    seen = {r.unseen: r for r in residue.validate(scored).collect()}
    assert seen[True].recall == seen[True].precision == 1 and seen[True].positive > 0
