"""Forms in which keys and tokens stand in texts, against a plain reading of them."""

import base64
import json
import random

import pytest

from skein.llm import secrets

INTEGER = b"\x02\x02\x01\x01"


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else b"\x81" + bytes([n]) if n < 256 else b"\x82" + n.to_bytes(2, "big")) + body


RSA = der(0x30, b"\x02\x01\x00" + INTEGER * 7 + der(2, b"\x11" * 300))
SEALED = der(0x30, der(0x30, der(6, b"\x2a\x86") + der(4, b"x" * 20)) + der(4, b"y" * 200))


def kinds(text):
    return [x[3] for x in secrets.scan_text(text)]


def lines(data, width=64):
    body = base64.b64encode(data).decode()
    return [body[i : i + width] for i in range(0, len(body), width)]


def pem(data, label="RSA PRIVATE KEY", headers="", end="\n"):
    return f"-----BEGIN {label}-----{end}{headers}{end.join(lines(data))}{end}-----END {label}-----"


def token(head, payload=None, signature="c2ln"):
    b64 = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    return f"{b64(json.dumps(head).encode())}.{b64(json.dumps(payload or {'sub': 1}).encode())}.{signature}"


@pytest.mark.parametrize("end", ["\n", "\r\n", "\\n", "\\r\\n"])
def test_pem_blocks(end):
    text = f"x {pem(RSA, end=end)} y"
    assert secrets.scan_text(text) == [(2, secrets.KINDS.index("pem"), len(text) - 2, "pem")]
    assert kinds(pem(SEALED, "ENCRYPTED PRIVATE KEY", end=end)) == ["pem"]
    headers = f"Proc-Type: 4,ENCRYPTED{end}DEK-Info: AES-128-CBC,0011{end}{end}"
    assert kinds(pem(b"\x07" * 320, headers=headers, end=end)) == ["pem"]
    assert kinds(pem(b"\x07" * 321, headers=headers, end=end)) == [] == kinds(pem(b"\x07" * 320, end=end))
    assert kinds(pem(RSA, "CERTIFICATE", end=end).replace(lines(RSA)[0], "A" * 64)) == []


def test_wrapped_without_marks():
    for after in ("", "\n", "\nHello there", "\nHello"):
        body = "\n".join(lines(RSA, 76))
        text = f"key:\n{body}{after}"
        assert secrets.scan_text(text) == [(5, secrets.KINDS.index("der"), 5 + len(body), "der")], after
    assert kinds("\n".join(lines(b"\x55" * 300))) == []


def test_tokens():
    good = token({"alg": "HS256"})
    for before in ("", "Bearer ", "x-", "session_", "(", "a.b.", "="):
        assert secrets.scan_text(before + good) == [(len(before), secrets.KINDS.index("jwt"), len(before + good), "jwt")], before
    assert kinds(f"{good}.{good}") == ["jwt", "jwt"] and kinds("a" + good) == []
    for bad in (token({"alg": "none"}), token({"alg": "None"}, signature="c2ln"), good.rpartition(".")[0] + ".", good.rpartition(".")[0], token({"typ": "x"}), token({"alg": 1}), "eyJ.eyJ.eyJ"):
        assert "jwt" not in kinds(f"see {bad} here"), bad


def test_long_runs_take_little_time():
    for text in ("-----BEGIN A PRIVATE KEY-----" * 20_000, "a" * 400_000, "eyJ" * 100_000, "eyJ." * 100_000, ("A" * 64 + "\n") * 8_000, "-eyJ" * 100_000 + ".e30.x", "0af" * 100_000):
        kinds(text)


def test_random_texts_keep_spans_where_they_are():
    rng = random.Random(2)
    forms = [pem(RSA), token({"alg": "RS256"}), base64.b64encode(RSA).decode(), RSA.hex(), pem(RSA, end="\\n")]
    names = ["pem", "jwt", "der", "der", "pem"]
    for _ in range(100):
        text, want = "", []
        for _ in range(rng.randint(1, 6)):
            k = rng.randrange(len(forms))
            text += rng.choice(["word é ", "\n", "; ", "𝄞 "]) + "then "
            want.append((names[k], len(text), len(text) + len(forms[k])))
            text += forms[k] + " "
        assert [(x[3], x[0], x[2]) for x in secrets.scan_text(text) if x[3] not in secrets.BASE_KINDS] == want
