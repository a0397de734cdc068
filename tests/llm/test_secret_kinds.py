import random
import re
import string
import time

import pytest
import zstandard
from techtrail.llm import secrets

BASE64 = string.ascii_letters + string.digits + "+/"
rng = random.Random(8)


def drawn(letters, n):
    return "".join(rng.choice(letters) for _ in range(n))


#: Texts around a planted secret of each kind, and the secret.
PLANTED = {
    "private key": lambda: ("config\n{}\nend", "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(drawn(BASE64, 64) for _ in range(rng.randint(3, 20))) + "\n-----END RSA PRIVATE KEY-----"),
    "key of many lines": lambda: ("private_key: |\n  {}\nname: x", "\n  ".join(drawn(BASE64, 64) for _ in range(20))),
    "letters": lambda: ("the bearer credential {} is used", drawn(string.ascii_letters, 40)),
    "short": lambda: ("the bearer credential {} is used", drawn(string.ascii_letters + string.digits, 15)),
    "capital hex": lambda: ("the api key was {} once", drawn("0123456789ABCDEF", 40)),
    "uuid": lambda: ("client secret is {} ok", "-".join(drawn("0123456789abcdef", n) for n in (8, 4, 4, 4, 12))),
    "digits": lambda: ("secret number is {} ok", drawn(string.digits, 30)),
    "after a name": lambda: ("credentials.store = Vault({})", drawn(BASE64, 48)),
}


@pytest.mark.parametrize("kind", PLANTED)
def test_recall_of_planted_secrets(kind):
    compressor, found = secrets.primed(" ".join(secrets.CODE_WORDS).encode()), 0
    for _ in range(200):
        frame, secret = PLANTED[kind]()
        text = frame.format(secret)
        a, b = text.index(secret), text.index(secret) + len(secret)
        covered = set()
        for x, _, y in [*secrets.base_spans(text), *secrets.novel_spans(text, compressor, secrets.base_spans(text))]:
            covered.update(range(x, y))
        found += sum(i in covered for i in range(a, b)) >= 0.9 * len(secret)
    assert found >= 180


def test_names_are_left_alone():
    compressor = secrets.primed(" ".join(secrets.CODE_WORDS).encode())
    for text in ("the secret of aws_secret_access_key_id and client_secret_private_key", "token: internationalization of credentials", "password policy of the organisation's administrators", "api_key environment variable config/settings/credentials/user"):
        assert secrets.novel_spans(text, compressor, secrets.base_spans(text)) == []


def test_novelty_is_what_compression_adds():
    """Against sizes that are taken without the operator's helpers."""
    dictionary = b"secret credential password"
    plain = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False)
    for _ in range(100):
        text = f"my credential {drawn('ab1', rng.randint(12, 40))} and {drawn(BASE64, 20)}1a too"
        want = []
        strings = [m.span() for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text) if secrets.is_candidate(m[0])]
        for a, b in strings:
            around = "".join(c for i, c in enumerate(text) if not any(x <= i < y for x, y in strings))
            if len(plain.compress((text[:0] + "".join(c for i, c in enumerate(text) if i in range(a, b) or not any(x <= i < y for x, y in strings))).encode())) - len(plain.compress(around.encode())) >= 0.6 * (b - a):
                want.append((a, 3, b))
        assert secrets.novel_spans(text, secrets.primed(dictionary), []) == want


@pytest.mark.parametrize("text", ["-----BEGIN PRIVATE KEY-----" * 20_000, "-----BEGIN RSA PRIVATE KEY-----\n" + ("A" * 64 + "\n") * 20_000, "secret " + "A1" * 500_000, "PRIVATE KEY " * 50_000, "private key\n" + ("a1" * 20 + ",\n") * 20_000])
def test_time_grows_with_length_alone(text):
    began = time.perf_counter()
    spans = list(secrets.candidates(text))
    assert time.perf_counter() - began < 5
    assert spans == sorted(spans) and all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
