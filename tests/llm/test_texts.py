"""Token ids against the public library, mixing, and text statistics."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from talkgrid.llm import quality
from talkgrid.llm.bpe import count_tokens, decode_ids, encode_texts
from talkgrid.llm.mixing import mix_sources

ODD = ["", None, " ", "a", "aaa", "a" * 3000, "Hello world's  end\n\n x", "<|endoftext|>", "\x00\x1c \x1f\x85 ", "été ñandú", "日本語 テキスト", "👍🏽🎙️", "it's I'LL 12345 1.5e-3", "  lead", "trail  ", "​﻿", "x y", "ab" * 500]


def test_ids_are_those_of_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choice("abc XYZ.,'\n0é😀") for _ in range(rnd.randrange(200))) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").withColumn("ids", F.lit(0))
    got = {r.id: list(r.ids) for r in encode_texts(df, "text", ["id"]).collect()}
    for i, text in enumerate(texts):
        assert got[i] == t.encode(text or "", add_special_tokens=False).ids, repr(text)
    counts = {r.id: r.n_tokens for r in count_tokens(df, "text", ["id"]).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    back = {r.id: r.text for r in decode_ids(encode_texts(df, "text", ["id"]), "ids", ["id"]).collect()}
    assert back == {i: x or "" for i, x in enumerate(texts)}
    assert encode_texts(df.limit(0), "text", ["id"]).collect() == []
    assert decode_ids(spark.createDataFrame([(1, None), (2, [99999, None, 64])], "id int, ids array<int>"), "ids", ["id"]).orderBy("id").collect()[1].text == "a"


def test_a_word_of_millions_of_signs(spark):
    df = spark.createDataFrame([(1, "a" * 3_000_000)], "id int, text string")
    assert count_tokens(df, "text", ["id"]).first().n_tokens == 750_000


def test_mixing(spark):
    data = [(i, s, n) for i, (s, n) in enumerate([("big", 100 + i % 7) for i in range(3000)] + [("small", 50)] * 20 + [("other", 9)] * 5 + [(None, 4), ("big", None), ("big", 0)])]
    df = spark.createDataFrame(data, "doc bigint, source string, size bigint").withColumn("rank", F.lit(1))
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 3), ("none", 0.1, 5), ("small", None, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    drawn, report = mix_sources(df, targets, "doc", "source", "size")
    r = {x.source: x for x in report.collect()}
    assert set(r) == {"big", "small", "none"} and r["small"].short and r["none"].short and not r["big"].short
    assert r["small"].drawn == 3 * 1000 and abs(r["big"].drawn - r["big"].desired) <= 107 and r["none"].drawn == 0
    assert r["big"].actual_share == pytest.approx(r["big"].drawn / (r["big"].drawn + 3000))
    copies = {x.doc: x.copies for x in drawn.collect()}
    assert all(copies[i] == 3 for i, s, _ in data if s == "small") and max(copies.values()) == 3
    assert copies == {x.doc: x.copies for x in mix_sources(df.repartition(7), targets, "doc", "source", "size")[0].collect()}
    assert copies != {x.doc: x.copies for x in mix_sources(df, targets, "doc", "source", "size", seed=1)[0].collect()}


def test_mixing_repeats_and_draws(spark):
    df = spark.createDataFrame([(i, "a" if i < 100 else "b", 10) for i in range(1100)], "doc bigint, source string, size bigint")
    targets = spark.createDataFrame([("a", 0.25, 9), ("b", 0.75, 1)], "source string, target_share double, max_repeats int")
    drawn, report = mix_sources(df, targets, "doc", "source", "size")
    a = {x.source: x for x in report.collect()}["a"]
    assert a.drawn == pytest.approx(2750, abs=5) and not a.short
    assert Counter(x.copies for x in drawn.filter("source = 'a'").collect()) == {3: 75, 2: 25}


def test_documents_are_drawn_with_probabilities_that_grow_with_the_root_of_their_size(spark):
    df = spark.createDataFrame([(i, "a", 400 if i % 2 else 100) for i in range(20_000)] + [(100_000 + i, "b", 1000) for i in range(10_000)], "doc bigint, source string, size bigint")
    targets = spark.createDataFrame([("a", 0.1, 1), ("b", 0.9, 9)], "source string, target_share double, max_repeats int")
    drawn = mix_sources(df, targets, "doc", "source", "size")[0]
    n = {r["size"]: r["count"] for r in drawn.filter("source = 'a'").groupBy("size").count().collect()}
    # 1.5 m of 5 m signs, with p = 1.5 m * root(n) / sum(n * root(n)): 0.1667 of the short and 0.3333 of the long ones
    assert n[100] / 10_000 == pytest.approx(1 / 6, abs=0.02) and n[400] / 10_000 == pytest.approx(1 / 3, abs=0.02)
    # a document that is more than its share is certain
    more = df.unionByName(spark.createDataFrame([(-1, "a", 100_000)], df.schema))
    assert all(mix_sources(more, targets, "doc", "source", "size", seed=k)[0].filter("doc = -1").count() == 1 for k in (1, 2))


def test_mixing_nothing(spark):
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    docs = spark.createDataFrame([], "doc bigint, source string, size bigint")
    drawn, report = mix_sources(docs, targets, "doc", "source", "size")
    assert drawn.collect() == [] and report.first().actual_share is None and not report.first().short
    assert mix_sources(docs, targets.limit(0), "doc", "source", "size")[1].collect() == []


PROSE = [
    "We had to keep the original file, since the room was too warm. Nobody knew why the speaker label had been left under the stairs.",
    "the answer was tired and most listeners did not ask for more so we waited by the open window until the clock had stopped and went home",
    "[00:04:19 - 00:04:38] Caller B\nWeak battery warnings usually shorten room echoes, particularly under studio conditions.\n\n[00:04:38 - 00:04:43] Caller C\nI am sorry, but I did not hear what the tenant said about the backup drive.",
    "There were nine attempts left when the\nnight operator forgot the broken hinge\nin the kitchen of the waiting area and\nwent out to look for the older speaker\nwho had told the team lead about it.",
    "The second caller spoke for 263 seconds, 0.263 of the total, with 22.4 dB of headroom. At 10:10 the level fell to -44.8 dB and stayed there for 848 seconds.",
    "VERSO LA FINE IL TECNICO HA CONTROLLATO IL VECCHIO NASTRO E NON HA TROVATO NULLA. LA CONDUTTRICE SI TROVAVA VICINO ALLA FINESTRA.",
    "She said that the line was bad, so we waited in the waiting area for a while.\n- the tape\n- a chair\nThen the moderator came back and asked about the draft agenda and the seating plan again.",
]
JUNK = [
    "- the sample rate\n- send the form today\n- our guest\n- grant report\n- the trainee", "a) invoice;\nb) the stairs;\nc) long pause;\nd) harbour forecast;", "The clerk found the speaker label this morning.\n" + "\n".join(f"{i},{i * 3.5},Speaker_{i}" for i in range(40)),
    "| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |", '{"start": 1, "label": "x"}\n{"start": 2, "label": "y"}', "uh, " * 60, "thank you " * 50, "." * 200, "e" * 300, "&*}[|**//#%=#[}@*[<|@>+>%[*&|{[~$+", "75 58 e1 06 0d 1b e0 bc 97 56 9b 1c 0a 1c fc 70 69 c3 b9 dd b4 37 8b",
    "PvBFCH9MnV/WqlqMaO70jEVs0vYN0Z1oRbXy2uz21O3QyWLcMtZmwlb/WzN+qLMVPMOTqIjku/s7jc2fBHXLDvmzaRVgBd2efyG97PT2yf5Sp9Pbsu2Y6aW7", "8691757 563 66717 4864701 612 749 74158 35936073 737 5 143 964 3 369181",
    "be what could one then From. about most you my their who i and only All. how a could he those from could of no out of you my how Were.",
]


def test_prose_and_junk(spark):
    common = spark.read.parquet("/root/testdata/sf0.001/common_words.parquet")
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.lit(-1).cast("bigint").alias("id"), "text")
    mine = spark.createDataFrame([(i, t) for i, t in enumerate(PROSE + JUNK + ["", None, " \n\t"])], "id bigint, text string")
    out = {r.id: r for r in quality.text_statistics(base.unionByName(mine), "text", ["id"], common).filter("id >= 0").collect()}
    wrong = [(i, (PROSE + JUNK)[i][:60]) for i in range(len(PROSE + JUNK)) if out[i].is_prose != (i < len(PROSE))]
    assert not wrong
    for i in range(len(PROSE + JUNK), len(out)):
        assert out[i].is_prose is None and out[i].n_words == 0


def test_verdicts_hang_on_no_other_row(spark):
    common = spark.read.parquet("/root/testdata/sf0.001/common_words.parquet")
    scrambled = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id = 2762").select("text")
    rest = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    skewed = rest.unionByName(spark.range(500).select((-1 - F.col("id")).alias("doc_id")).crossJoin(scrambled))
    found = {r.doc_id: r.is_prose for r in quality.text_statistics(skewed, "text", ["doc_id"], common).select("doc_id", "is_prose").collect()}
    assert not any(v for k, v in found.items() if k < 0)
    alone = {r.doc_id: r.is_prose for r in quality.text_statistics(rest, "text", ["doc_id"], common).collect()}
    assert alone == {k: v for k, v in found.items() if k >= 0}


#: One sentence in each language; none of the documents has them.
LANGUAGES = [
    "Sabah ofise geldiğimizde kapının neden açık olduğunu bilmiyorum ama kimse yeni müdürle bu konuda konuşmak istemedi bugün.",
    "En tiedä miksi ovi oli auki kun tulimme aamulla toimistoon, mutta kukaan ei halunnut puhua siitä uuden johtajan kanssa tänään.",
    "Nie wiem, dlaczego drzwi były otwarte, kiedy rano przyszliśmy do biura, ale nikt nie chciał o tym rozmawiać z nowym kierownikiem.",
    "Tôi không biết tại sao cửa lại mở khi chúng tôi đến văn phòng vào buổi sáng, nhưng không ai muốn nói chuyện với người quản lý mới.",
    "Nem tudom, miért volt nyitva az ajtó, amikor reggel megérkeztünk az irodába, de senki sem akart erről beszélni az új vezetővel.",
    "Nevím, proč byly dveře otevřené, když jsme ráno přišli do kanceláře, ale nikdo o tom nechtěl mluvit s novým vedoucím.",
    "Я не знаю, почему дверь была открыта, когда мы утром пришли в офис, но никто не хотел говорить об этом с новым начальником.",
    "Δεν ξέρω γιατί η πόρτα ήταν ανοιχτή όταν φτάσαμε το πρωί στο γραφείο, αλλά κανείς δεν ήθελε να μιλήσει γι' αυτό με τον νέο διευθυντή.",
    "لا أعرف لماذا كان الباب مفتوحا عندما وصلنا إلى المكتب في الصباح، لكن لم يرغب أحد في الحديث عن ذلك مع المدير الجديد.",
    "אני לא יודע למה הדלת הייתה פתוחה כשהגענו בבוקר למשרד, אבל אף אחד לא רצה לדבר על זה עם המנהל החדש.",
    "아침에 우리가 사무실에 도착했을 때 왜 문이 열려 있었는지 모르겠지만 아무도 새 관리자와 그것에 대해 이야기하고 싶어 하지 않았다.",
    "Ik weet niet waarom de deur open stond toen we 's ochtends op kantoor kwamen, maar niemand wilde er met de nieuwe manager over praten.",
    "Sijui kwa nini mlango ulikuwa wazi tulipofika ofisini asubuhi, lakini hakuna mtu aliyetaka kuzungumza kuhusu jambo hilo na meneja mpya.",
]


def test_any_language_is_prose_and_its_letters_in_another_order_are_not(spark):
    def scrambled(text, seed):
        rnd = random.Random(seed)
        return re.sub(r"[^\W\d_]{2,}", lambda m: "".join(rnd.sample(m[0], len(m[0]))), text)

    def mixed(text, seed):
        letters = [c for c in text if c.isalpha()]
        random.Random(seed).shuffle(letters)
        return "".join(letters.pop() if c.isalpha() else c for c in text)

    texts = LANGUAGES + [f(t, seed) for f in (scrambled, mixed) for t in LANGUAGES for seed in (1, 2)]
    out = {r.id: r.is_prose for r in quality.text_statistics(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text", ["id"], spark.createDataFrame([("en", "the")], "lang string, word string")).collect()}
    assert [i for i in range(len(LANGUAGES)) if not out[i]] == []
    # one or two short sentences of the rest may look like words by chance
    assert sum(out[i] for i in range(len(LANGUAGES), len(texts))) <= 1


def test_verse_is_prose_and_word_counts_do_not_hang_on_length(spark):
    verse = "The woods are lovely, dark and deep,\nBut I have promises to keep,\nAnd miles to go before I sleep,\nAnd miles to go before I sleep."
    df = spark.createDataFrame([(1, verse)], "id int, text string")
    assert quality.text_statistics(df, "text", ["id"], spark.createDataFrame([("en", "the")], "lang string, word string")).first().is_prose
    numbers = "1 22 333 4. "
    assert quality._words(numbers * 20) == 0 and quality._words(numbers * 200) == 0 and quality._words("ab cd " * 500) == 1000


def test_statistics_by_hand(spark):
    common = spark.createDataFrame([("en", "the"), ("en", "a"), ("de", "der"), (None, None)], "lang string, word string")
    df = spark.createDataFrame([(1, "The cat. The cat.\nThe dog!\nThe dog!\n\nx1 y", 5)], "id int, text string, n_words int")
    r = quality.text_statistics(df, "text", ["id"], common).first()
    assert r.n_words == 10 and r.common_word_share == 0.4 and r.repeated_line_share == pytest.approx(0.25)
    assert r.symbol_ratio == pytest.approx(4 / 31) and r.ending_line_share == 0.75 and r.phrase_coverage == pytest.approx(12 / 27)
    assert quality.text_statistics(df.limit(0), "text", ["id"], common).collect() == []
    assert quality.text_statistics(df, "text", ["id"], common.limit(0)).first().common_word_share == 0.0


def test_phrase_coverage_is_that_of_counting_each_phrase(spark):
    def counted(tokens):
        best = 0
        for k in range(1, quality.PHRASE + 1):
            times = Counter(tuple(tokens[i : i + k]) for i in range(len(tokens) - k + 1))
            n = max(times.values(), default=0)
            best = max([best, *(n * sum(map(len, p)) for p, m in times.items() if m == n and n >= 4)])
        return min(1.0, best / sum(map(len, tokens)))

    rnd = random.Random(5)
    for size in range(1, 400):
        tokens = [f"{'w' * (i % 5)}{i}" for i in (int(rnd.expovariate(0.15)) for _ in range(size))]
        assert quality.phrase_coverage(tokens, Counter(tokens)) == pytest.approx(counted(tokens))


class Counting:
    """A pattern that counts the signs it was put to."""

    def __init__(self, pattern):
        self.pattern, self.signs = pattern, 0

    def findall(self, text):
        self.signs += len(text)
        return self.pattern.findall(text)


def test_a_word_seen_before_is_not_matched_again(monkeypatch):
    rnd = random.Random(3)
    lines = [" ".join(rnd.choice(LANGUAGES[0].split()) for _ in range(20)) for _ in range(500)]
    patterns = [Counting(quality._WORD), Counting(quality._CLAUSES)]
    monkeypatch.setattr(quality, "_WORD", patterns[0])
    monkeypatch.setattr(quality, "_CLAUSES", patterns[1])
    assert sum(len(x) for _, x in quality.units(lines)) > 50_000
    assert max(p.signs for p in patterns) < 1000


def test_sums_over_pieces_are_those_of_the_whole_text():
    signs = list("abXYZΣσİßñ019_") + list(" \n\t\x0b\x1c\x1f\x85\xa0\u3000\u2009 ") + list(".,;:!?…。！？、，؟،()[]|'’\"”»-–*") + list("日本語ไทยкоДα") + ["\u0300", "\u200b", "\U00020000", "( 1.5 s )"]
    rnd = random.Random(7)
    for size in range(1, 1500):
        text = "".join(rnd.choices(signs, k=size % 150 + 1))
        words, unspaced = len(quality._WORD.findall(text)), len(quality._UNSPACED.findall(text))
        assert quality._counts(text) == (words + unspaced // 2, len(quality._CLAUSES.findall(text)))
        assert quality._tokens(text.split()) == quality._TOKEN.findall(text.lower())
        assert quality._ends(text) == bool(quality._ENDS.search(text))
        letters, digits, blanks, *_ = quality.signs_of(text)
        assert letters == sum(map(str.isalpha, text)) and digits == sum(c.isalnum() and not c.isalpha() for c in text) and blanks == sum(map(str.isspace, text))


def test_long_texts_are_taken_whole(spark):
    long = "The archivist was sitting near the loading dock and described the broken hinge to the trainee. " * 2
    df = spark.createDataFrame([(1, (long + "\n") * 3000)], "id int, text string")
    r = quality.text_statistics(df, "text", ["id"], spark.createDataFrame([("en", "the")], "lang string, word string")).first()
    assert r.n_words == 16 * 2 * 3000 and r.repeated_line_share > 0.99
    assert count_tokens(df, "text", ["id"]).first().n_tokens > 90_000
