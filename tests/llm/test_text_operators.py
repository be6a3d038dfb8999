"""Encoding, sentences and leaks: round trips, brute force and edge cases."""

import os
import random

import numpy as np
import pytest

from hewn.llm import encode, leaks, sentences

D = "doc_id long, text string, ids string, id string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], D)


ODD = [None, "", "   \n ", "Hello, world! It's 2024.", "<|endoftext|>", "a" * 5000, " " * 3000 + "x", "日本語のテキスト。" * 400, "ไทย ไทย", "\x00\x01\ufeff", "é́" * 50, "word " * 9000, "😀👍🏽 ok"]


@pytest.mark.skipif(not os.path.exists(encode.VOCABULARY_DIR), reason="no vocabulary")
def test_encoding_equals_library_and_round_trips(spark):
    enc = encode.encoding()
    got = {r.doc_id: r.ids for r in encode.encode_corpus(docs(spark, ODD)).collect()}
    assert len(got) == len(ODD)
    for i, t in enumerate(ODD):
        assert got[i] == (enc.encode_ordinary(t) if t else [])
        assert encode.decode_ids(got[i], enc) == (t or "").encode()
    assert encode.encode_corpus(docs(spark, [])).count() == 0


@pytest.mark.skipif(not os.path.exists(encode.VOCABULARY_DIR), reason="no vocabulary")
def test_safe_cuts_change_no_id():
    enc = encode.encoding()
    rnd = random.Random(1)
    for _ in range(60):
        text = "".join(rnd.choice(["a", "é", " ", "  ", "\n", "1", "!", "'s", "漢", "\t", "don't "]) for _ in range(300))
        cut = [i for p in encode.pieces(text, 20) for i in enc.encode_ordinary(p)]
        assert cut == enc.encode_ordinary(text)


CASES = [
    ("It works. Yes!", ["It works.", "Yes!"]),
    ("Dr. Brask paid $1.135, i.e. less than 5 p.m. rates. Done", ["Dr. Brask paid $1.135, i.e. less than 5 p.m. rates.", "Done"]),
    ('Ann replied, "It works. I checked twice." The next one failed.', ['Ann replied, "It works. I checked twice."', "The next one failed."]),
    ("“Is it old? Then go!” was all that Orla said. Fine.", ["“Is it old? Then go!” was all that Orla said.", "Fine."]),
    ("‘Too old?’ Ilse asked, ‘or too new?’ The end.", ["‘Too old?’ Ilse asked, ‘or too new?’", "The end."]),
    ("The map (see a.py. It is long.) was fine. rank_digest ends.", ["The map (see a.py. It is long.) was fine.", "rank_digest ends."]),
    ("It was... let us say... odd. It sits in the U.S. Every one.", ["It was... let us say... odd.", "It sits in the U.S.", "Every one."]),
    ("Er hält z. B. den 91. Abschnitt. „Nein. Doch“, rief Eva.", ["Er hält z. B. den 91. Abschnitt.", "„Nein. Doch“, rief Eva."]),
    ("Selon M. Brask, p. ex. ceci ! « Il faut. Oui », dit-elle.", ["Selon M. Brask, p. ex. ceci !", "« Il faut. Oui », dit-elle."]),
    ("Строк и т. д. Буфер т. е. мал.", ["Строк и т. д.", "Буфер т. е. мал."]),
    ("“先停下。明天再来。”他写道。很好！", ["“先停下。明天再来。”他写道。", "很好！"]),
    ("「要りますか？」「いいえ。」と話した。次。", ["「要りますか？」「いいえ。」と話した。", "次。"]),
    ("सूची बनती है। डॉ. वर्तन ने पढ़ा।", ["सूची बनती है।", "डॉ. वर्तन ने पढ़ा।"]),
    ("هل راجع؟ قرأ د. ورتان الملف.", ["هل راجع؟", "قرأ د. ورتان الملف."]),
    ("ระบบสร้างดัชนี ขีดจำกัดคือ 57 รายการ", ["ระบบสร้างดัชนี", "ขีดจำกัดคือ 57 รายการ"]),
    ("No end mark\n\nNext one. 🚀 Then", ["No end mark", "Next one. 🚀", "Then"]),
    ("It costs 8.72 ms. A new one took 3 s. Ms. Venn saw it.", ["It costs 8.72 ms.", "A new one took 3 s.", "Ms. Venn saw it."]),
    ("Am 3. Mai fiel es auf 9. Nur das.", ["Am 3. Mai fiel es auf 9.", "Nur das."]),
    ("This is modern art. The next one is not.", ["This is modern art.", "The next one is not."]),
    ("Close the tab. Then open the app. It starts.", ["Close the tab.", "Then open the app.", "It starts."]),
    ("We hit the cap. Nothing else failed.", ["We hit the cap.", "Nothing else failed."]),
    ("See the env. It is set.", ["See the env.", "It is set."]),
    ("Plan B. Then we go. J. R. Strand is in fig. 3 and art. 5 of it.", ["Plan B.", "Then we go.", "J. R. Strand is in fig. 3 and art. 5 of it."]),
    ("Voir l'art. 12 et env. 30 lignes. Le reste est pour M. Brask.", ["Voir l'art. 12 et env. 30 lignes.", "Le reste est pour M. Brask."]),
    ("The unit is m. Then it grew. Ein Teil, d. h. der Rest, ist für Hr. Brask. Das war es.", ["The unit is m.", "Then it grew.", "Ein Teil, d. h. der Rest, ist für Hr. Brask.", "Das war es."]),
    ("line one\nstill one.\n \t\nnew", ["line one\nstill one.", "new"]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_sentences(text, want):
    assert [text[a:b] for a, b in sentences.sentence_spans(text)] == want


def test_sentences_cover_all_but_blanks(spark):
    texts = ["".join(random.Random(i).choice(["a", "B", ".", " ", "\n", "?", '"', "(", ")", "。", "ก", "1", "é"]) for _ in range(200)) for i in range(80)]
    for t in texts:
        spans = sentences.sentence_spans(t)
        assert all(a < b and t[a:b] == t[a:b].strip() for a, b in spans)
        assert all(spans[i][1] <= spans[i + 1][0] for i in range(len(spans) - 1))
        assert "".join(t[a:b] for a, b in spans).replace(" ", "").replace("\n", "") == "".join(t.split())
    got = sentences.sentences(docs(spark, [None, "", " \n", "A b. C d."]))
    assert [(r.doc_id, r.start_at, r.end_at) for r in got.collect()] == [(3, 0, 4), (3, 5, 9)]
    assert sentences.sentences(docs(spark, [])).count() == 0


ITEM = "item_id long, question string, gold struct<answer_text:string>, extra string"


def grams(text):
    d = leaks.words(text or "")
    return {tuple(d[j : j + 6]) for j in range(len(d) - 5)}


def plain(d, item, share=0.4):
    """Coverage by looking up every run of the item among all runs of the document."""
    p = leaks.words(item or "")
    if len(p) < 6:
        return False
    covered = set()
    for i in range(len(p) - 5):
        if tuple(p[i : i + 6]) in d:
            covered |= set(range(i, i + 6))
    return len(covered) >= share * len(p)


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    some = lambda n: [rnd.choice(vocab) for _ in range(n)]
    opening = "Answer from the text alone please."
    items, texts = [], []
    for i in range(30):
        q, a = some(24), some(90)
        items.append((i, f"{opening} {' '.join(q)}", (" ".join(a),), "x"))
        body = some(rnd.choice([40, 300, 3000]))
        for kind in range(4):
            at = rnd.randrange(len(body))
            part = {0: a, 1: a[:40], 2: a[:12], 3: [w if k % 9 else "changed" for k, w in enumerate(a)]}[kind]
            joined = " ".join(body[:at] + part + body[at:])
            texts.append(joined.upper() if kind == 1 else joined.replace(" ", "\n> ", 7) if kind == 3 else joined)
        texts.append(" ".join(body[:20] + q[4:18] + body[20:]))
    texts += [None, "", opening, " ".join(some(50))]
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(docs(spark, texts), spark.createDataFrame(items, ITEM)).collect()}
    want = {(d, i) for d, t in enumerate(map(grams, texts)) for i, (_, q, (a,), _x) in enumerate(items) if plain(t, q[len(opening) :]) or plain(t, a)}
    assert got == want and len(want) >= 90


def test_leaks_edges(spark):
    none = spark.createDataFrame([], ITEM)
    assert leaks.leaks(docs(spark, ["some text"]), none).count() == 0
    odd = spark.createDataFrame([(1, None, None, "x"), (2, "too short", ("five words are not enough",), "x")], ITEM)
    assert leaks.leaks(docs(spark, ["five words are not enough", None]), odd).count() == 0
    assert leaks.words("A&amp;b\\u00e9 \\\"Q\\\" ﬁne\n12. x") == ["a", "bé", "q", "fine", "x"]


def test_one_shared_run_in_full_windows_is_seen():
    rnd = random.Random(9)
    some = lambda k: [f"w{rnd.randrange(400)}" for _ in range(k)]
    texts = [some(12) for _ in range(900)]
    hashed = [leaks.shingles(" ".join(p)) for p in texts]
    bands = np.max([leaks.needs(h, 12) for h in hashed], 0).tolist()
    docs_ = [leaks.shingles(" ".join(some(10) + p[:6] + some(60))) for p in texts]
    doc, key = leaks.window_keys(np.concatenate(docs_), np.cumsum([len(h) for h in docs_]), bands)
    assert [i for i, h in enumerate(hashed) if not np.isin(leaks.passage_keys(h, 12), key[doc == i]).any()] == []


def test_bands_meet_the_miss_probability():
    one, two = (leaks.shingles(" ".join(f"{c}{i}" for i in range(n))) for c, n in (("a", 15), ("b", 29)))
    for upper, a, b in zip(leaks.SIZES, leaks.needs(one, 15), leaks.needs(two, 29)):
        assert (1 - 1 / (upper + 10 - 1)) ** a <= leaks.MISS
        assert (1 - 2 / (upper + leaks.SEGMENT - 2)) ** b <= leaks.MISS


def test_bitmap_holds_all_and_little_else():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**64, 60_000, dtype=np.uint64)
    bits = leaks.bitmap(h[:30_000])
    assert leaks.has(bits, h[:30_000]).all() and leaks.has(bits, h[30_000:]).mean() < 1e-3


def test_twenty_thousand_items(spark):
    """Items grow without a bound: nothing of them but two bitmaps is on the driver or broadcast."""
    rnd = random.Random(3)
    some = lambda n: " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))
    answers = [some(20) for _ in range(20_000)]
    items = spark.createDataFrame([(i, None, (a,), "x") for i, a in enumerate(answers)], ITEM)
    held = list(range(0, 20_000, 400))
    texts = [f"{some(50)} {answers[i]} {some(30)}" for i in held] + [some(200) for _ in range(50)]
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(docs(spark, texts), items).collect()}
    assert got == set(enumerate(held))
