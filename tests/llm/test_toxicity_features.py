import math
import random

from techtrail.llm import toxicity

LETTERS = set("abcdefghijklmnopqrstuvwxyz")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_words(text):
    """Words of a text, with every printable ASCII sign as a blank."""
    return "".join(" " if 33 <= ord(c) < 127 and not c.isalnum() or c in "\t\n\r\x0b\x0c" else c for c in ascii_lower(text)).split(" ")


def obfuscated(text):
    """Obfuscated words, found by trying all beginnings and ends: letters, signs and then a letter, or letters one by one with signs between them."""
    text, found, at = ascii_lower(text), [], 0
    tail = LETTERS | set("0123456789@$!|+*#")
    while at < len(text):
        end = None
        if text[at] in LETTERS and not (at and (text[at - 1] in LETTERS or text[at - 1] in "0123456789")):
            i = at
            while i < len(text) and text[i] in LETTERS:
                i += 1
            j = i
            while j < len(text) and text[j] in "0123456789@$!|+*#":
                j += 1
            if j > i and j < len(text) and text[j] in LETTERS:
                end = j + 1
                while end < len(text) and text[end] in tail:
                    end += 1
            else:
                i, n = at + 1, 0
                ends = []
                while i + 1 < len(text) and text[i] in "-._" and text[i + 1] in LETTERS:
                    i, n = i + 2, n + 1
                    if n >= 3 and not (i < len(text) and text[i] in LETTERS):
                        ends.append(i)
                end = ends[-1] if ends else None
        if end:
            found.append(text[at:end])
            at = end
        else:
            at += 1
    return found


def plain_features(text, lexicon):
    words = [w for w in plain_words(text) if w]
    size, n = len(text.encode()), max(1, len(words))
    abusive = [i for i, w in enumerate(words) if w in toxicity.LEXICON]
    weight = lambda w: max([lexicon.get(w.encode(), 0.0)] + [lexicon.get(w.encode()[:k] + b"*", 0.0) for k in (4, 5, 6) if len(w.encode()) > k])
    learned = [w for w in words if weight(w)]
    odd = obfuscated(text)
    signs = sum(33 <= ord(c) < 127 and not c.isalnum() for c in text)
    has_case = lambda w: any("A" <= c <= "Z" for c in w) and not any(c in LETTERS for c in w)
    return [
        math.log(len(words) + 1), len(abusive), 1000 * len(abusive) / n, len({words[i] for i in abusive}),
        sum(any(words[j] in toxicity.SECOND_PERSON for j in range(max(0, i - 5), min(len(words), i + 6))) for i in abusive),
        1000 * sum(w in toxicity.SECOND_PERSON for w in words) / n, sum("A" <= c <= "Z" for c in text) / size if size else 0,
        1000 * text.count("!") / n, 1000 * text.count("?") / n, 1000 * (signs - text.count(".") - text.count(",")) / n, 1000 * sum(c in "0123456789" for c in text) / n,
        1000 * len(odd) / n, sum(toxicity.reads_as_abuse(w.encode()) for w in odd), size / n, sum(has_case(w) for w in "".join(" " if c in "\t\n\r\x0b\x0c" else c for c in text).split(" ")) / n,
        len(learned), 1000 * len(learned) / n, len(set(learned)), sum(map(weight, learned)) / n,
    ]


def test_features_match_a_plain_version():
    rng = random.Random(7)
    lexicon = {b"blorp": 3.0, b"snar*": 2.6, b"snarfl*": 4.0, "dégoû".encode()[:5] + b"*": 2.7}
    parts = ["you", "IDIOT", "idiot", "you're", "m0ron", "i.d.i.o.t", "s-c-u-m", "f*ck", "blorp", "snarfling", "snar", "SNARFLY!", "?!", "ok.", "123", "a1b2c", "dégoûtant", "É", "TU", "a.b", "x!y", "_", "\n", "hello,", "l00ser!!"]
    for _ in range(600):
        text = "".join(rng.choice(parts) + rng.choice([" ", "", "  ", "\t"]) for _ in range(rng.randint(0, 25)))
        got, want = toxicity.features(text, toxicity.Weights(lexicon)), plain_features(text, lexicon)
        assert len(got) == len(want) == len(toxicity.NAMES)
        for name, a, b in zip(toxicity.NAMES, got, want, strict=True):
            assert math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12), (name, text, a, b)


def test_obfuscated_words_read_as_abuse():
    for word, want in (("m0r0n", True), ("f*cking", True), ("s-c-u-m", True), ("h3llo", False), ("sh*t", True), ("a.b.c.d", False), ("1d10t", True)):
        assert toxicity.reads_as_abuse(word.encode()) == want


def test_very_long_texts_take_time_by_their_length():
    import time

    for piece in ("you idiot ", "a1b", "a.b.", "x!", "A"):
        began = time.perf_counter()
        toxicity.features(piece * (2_000_000 // len(piece)), toxicity.Weights({}))
        assert time.perf_counter() - began < 15
