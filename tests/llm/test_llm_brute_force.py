"""Whole operators against versions of their own, written without their code: naive Bayes, the pattern grammar, long texts."""

import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from canopyspark.llm import bpe, embed, langid, packing, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def slow_features(text):
    """Hashed n-grams that start with a letter, one at a time."""
    chars = [c if c.isalpha() else " " for c in text.lower()]
    found = Counter()
    for at, c in enumerate(chars):
        if c == " ":
            continue
        h = 0
        for n in range(4):
            code = ord(chars[at + n]) if at + n < len(chars) else 32
            h = ((h ^ code) * 0x9E3779B1) & 0xFFFFFFFF
            h ^= h >> 15
            found[((h * 0x9E3779B1) & 0xFFFFFFFF) >> 16] += 1
    return found


def test_language_by_a_slow_bayes(spark):
    r = random.Random(5)
    vocabulary = {"en": "the of and words house light water".split(), "de": "der und das wörter haus licht wasser".split(), "fr": "le et les mots maison lumière eau".split()}
    rows = []
    for k in range(120):
        lang = r.choice(["en", "en", "en", "de", "fr"])
        mixed = vocabulary[lang] + (vocabulary["en"] if k % 4 == 0 else [])
        rows.append((k, " ".join(r.choice(mixed) for _ in range(r.randint(1, 9))) + r.choice(["", " 12!", "."]), None if k % 11 == 0 else lang, "s", 0))
    rows += [(200, None, "en", "s", 0), (201, "12 !", None, "s", 0), (202, "x", None, "s", 0)]
    counts, texts = defaultdict(Counter), Counter()
    for i, text, lang, *_ in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2 and lang and text is not None:
            counts[lang].update(slow_features(text))
            texts[lang] += 1
    sums = {x: sum(c.values()) + 0.5 * 65536 for x, c in counts.items()}
    out = {x.doc_id: x for x in langid.identify(spark.createDataFrame(rows, DOC)).collect()}
    for i, text, *_ in rows:
        f = slow_features(text or "")
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        if not f:
            assert (out[i].lang_pred, out[i].score) == ("und", 0.0)
            continue
        total = {x: math.log(texts[x] / sum(texts.values())) + sum(n * math.log((counts[x][b] + 0.5) / sums[x]) for b, n in f.items()) for x in counts}
        best = max(sorted(total), key=total.get)
        assert out[i].lang_pred == best and out[i].score == pytest.approx(1 / sum(math.exp(v - total[best]) for v in total.values()), rel=1e-3, abs=1e-4)


def test_no_labels_drop_the_same_rows(spark):
    rows = [(1, "12 !", None, "s", 0), (2, None, None, "s", 0), (3, "words", None, "s", 0)]
    assert [tuple(x) for x in langid.keep_known(spark.createDataFrame(rows, DOC)).collect()] == [rows[2]]


def slow_emissions(words, prefixes, text):
    """The grammar read as rules over the words of each clause."""
    found = Counter()

    def weight(w):
        return max([words.get(w, 0.0)] + [v for p, v in prefixes.items() if w.startswith(p) and len(w) > len(p)])

    for clause in re.split(r"[.!?;:\n|]", text.lower()):
        said = aimed = waiting = after_insult = False
        near = 0
        for w in re.findall(r"[^\W\d_]+", clause):
            kind = None
            value, was = 1.0, after_insult
            after_insult = False
            if w in toxicity.TARGETS:
                aimed = True
                if waiting:
                    kind, waiting = "threat", False
            elif w in toxicity.THREATS:
                waiting = True
            elif w in toxicity.NEGATIONS:
                near = toxicity.REACH
                continue
            elif w in toxicity.REPORTS:
                pass
            elif weight(w):
                kind, value, after_insult = "aimed" if aimed else "insult", weight(w) * (toxicity.REPEATED if was else 1), True
            if kind:
                plain = "threat" if kind == "threat" else "insult"
                kind = f"{plain}_negated" if near else f"{plain}_reported" if said else kind
                found[kind] += value
            near = max(0, near - 1)
            said = said or w in toxicity.REPORTS
    return found


def test_grammar_on_random_clauses():
    r = random.Random(11)
    words, prefixes = {"idiot": 2.0, "fool": 1.5}, {"scumm": 1.0}
    lexicon = toxicity.Lexicon(words, prefixes)
    pool = ["idiot", "FOOL", "scummiest", "kill", "you", "not", "said", "the", "house", "a1b", "ß", ".", "\n", ";"]
    for k in range(600):
        length = r.randint(0, 25) if k % 10 else r.randint(400, 900)
        rare = pool[:7] if k % 3 else pool
        text = " ".join(r.choice(rare) if r.random() < 0.4 else r.choice(pool[7:11]) for _ in range(length))
        e = lexicon.emissions(text)
        expected = slow_emissions(words, prefixes, text)
        assert {n: v for n, v in zip(toxicity.KINDS, e, strict=False) if v} == pytest.approx(dict(expected)), text


def test_both_classes_suffice_to_learn(spark):
    rows = [(k, "you zorgling fool of a zorgling" if k % 8 == 0 else f"a calm text about house {k}", "en", "s", 0) for k in range(1, 400)]
    labels = spark.createDataFrame([(k, 1, int(k % 8 == 0)) for k in range(1, 400)], "doc_id long, quality int, toxic int")
    out = {x.doc_id: x.predicted for x in toxicity.detect(spark.createDataFrame(rows, DOC), labels).collect()}
    assert all(out[k] == int(k % 8 == 0) for k in out)


WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def hard_texts():
    r = random.Random(2)
    han = "".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(150_000))
    return [han, "ab" * 100_000, "-" * 140_000, " " * 200_000 + "x", "é" * 70_000, f"it's {han[:70_000]}'ve {han[:9]}9", "\n" * 70_000, "1" * 70_000]


def test_long_texts_without_blanks():
    exact = Tokenizer.from_file(WORD)
    codec = bpe.Codec(WORD)
    for text in hard_texts():
        assert np.frombuffer(b"".join(codec.encode(text)), dtype="<u4").tolist() == exact.encode(text, add_special_tokens=False).ids
        assert max(len(b) for b, _ in codec.blocks(text)) <= 2 * bpe.BLOCK


def test_small_blocks(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 64)
    r, exact, codec = random.Random(1), Tokenizer.from_file(WORD), bpe.Codec(WORD)
    bits = ["a", "É", "é", "ß", "'s", "'", "-", "<|endoftext|>", "9", "xyz" * 30, "…", "ᄀ", "ᅡ", "日", "<", unicodedata.normalize("NFD", "é") * 9]
    for _ in range(200):
        text = "".join(r.choice(bits) for _ in range(r.randint(3, 40)))
        assert np.frombuffer(b"".join(codec.encode(text)), dtype="<u4").tolist() == exact.encode(text, add_special_tokens=False).ids, text


def test_window_holds_little():
    codec = bpe.Codec(WORD)
    run = codec.merges.running()
    for _ in range(50):
        run.feed([codec.inner[97]] * 1000)
        assert len(run.held) <= codec.merges.window


def test_packing_of_very_long_runs():
    exact = Tokenizer.from_file(BYTE)
    for text in [*hard_texts(), " " * 1_200_000 + "x"]:
        assert packing.encoded(BYTE, text) == exact.encode(text, add_special_tokens=False).ids


def test_vectors_of_any_magnitude(spark):
    rows = [(1, [1e200, 1e200], 0), (2, [1e-200, 1e-200], 0), (3, [1e200, -1e200], 0), (4, [3.0, 3.0], 0), (5, [5e-324, 5e-324], 0)]
    out = {x.vec_id: (x.n_links, x.component_id) for x in embed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert out == {1: (3, 1), 2: (3, 1), 3: (0, 3), 4: (3, 1), 5: (3, 1)}
