"""Digests, ciphers, signatures and key transport, and XML Signature and XML Encryption of one document.

Digests and AES are Spark's own functions; RSA, ECDSA and OAEP are plain
Python on integers. None of this has been reviewed as cryptography.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import re
import secrets
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ParserConfig
from . import c14n
from .tokenizer import Event, events

DS, XENC = "http://www.w3.org/2000/09/xmldsig#", "http://www.w3.org/2001/04/xmlenc#"
#: Identifiers of the algorithms.
URIS = {
    "sha256": XENC + "sha256", "sha384": "http://www.w3.org/2001/04/xmldsig-more#sha384", "sha512": XENC + "sha512",
    "rsa_sha256": "http://www.w3.org/2001/04/xmldsig-more#rsa-sha256", "rsa_sha384": "http://www.w3.org/2001/04/xmldsig-more#rsa-sha384",
    "rsa_sha512": "http://www.w3.org/2001/04/xmldsig-more#rsa-sha512", "ecdsa_sha256": "http://www.w3.org/2001/04/xmldsig-more#ecdsa-sha256",
    "aes128_cbc": XENC + "aes128-cbc", "aes256_cbc": XENC + "aes256-cbc", "aes128_gcm": "http://www.w3.org/2009/xmlenc11#aes128-gcm",
    "aes256_gcm": "http://www.w3.org/2009/xmlenc11#aes256-gcm", "rsa_oaep": "http://www.w3.org/2009/xmlenc11#rsa-oaep", "rsa_oaep_mgf1p": XENC + "rsa-oaep-mgf1p",
    "enveloped": DS + "enveloped-signature", "base64": DS + "base64", **c14n.URIS,
}
_DER = {"sha256": bytes.fromhex("3031300d060960864801650304020105000420"), "sha384": bytes.fromhex("3041300d060960864801650304020205000430"), "sha512": bytes.fromhex("3051300d060960864801650304020305000440")}


def name_of(uri: str) -> str | None:
    return next((k for k, v in URIS.items() if v == uri), None)


# columns


def digest(data: Column, algorithm: str = "sha256") -> Column:
    """The digest as bytes."""
    return F.unhex(F.sha2(data.cast("binary"), int(algorithm.removeprefix("sha"))))


def encrypt(data: Column, key: Column, algorithm: str = "aes256_gcm", iv: Column | None = None) -> Column:
    """GCM gives IV, ciphertext and tag, CBC IV and ciphertext."""
    mode = algorithm.rpartition("_")[2].upper()
    return F.aes_encrypt(data, key, F.lit(mode), F.lit("DEFAULT"), *([iv] if iv is not None else []))


def decrypt(data: Column, key: Column, algorithm: str = "aes256_gcm") -> Column:
    """Null for what doesn't authenticate or is badly padded."""
    mode = algorithm.rpartition("_")[2].upper()
    return F.try_aes_decrypt(data, key, F.lit(mode), F.lit("DEFAULT"))


# RSA


@dataclass(frozen=True)
class PublicKey:
    n: int
    e: int = 65537

    @property
    def size(self) -> int:
        return (self.n.bit_length() + 7) // 8


@dataclass(frozen=True)
class PrivateKey(PublicKey):
    d: int = 0

    @property
    def public(self) -> PublicKey:
        return PublicKey(self.n, self.e)


def _prime(bits: int) -> int:
    while True:
        p = secrets.randbits(bits) | 1 | 3 << (bits - 2)
        if all(p % q for q in (3, 5, 7, 11, 13, 17, 19, 23, 29)) and all(pow(a, p - 1, p) == 1 for a in (2, 3, 5, 7, 11)) and _miller(p):
            return p


def _miller(n: int, rounds: int = 24) -> bool:
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for _ in range(rounds):
        x = pow(secrets.randbelow(n - 3) + 2, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(r - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def generate_rsa(bits: int = 2048) -> PrivateKey:
    while True:
        p, q = _prime(bits // 2), _prime(bits // 2)
        if p != q and (p - 1) % 65537 and (q - 1) % 65537:
            return PrivateKey(p * q, 65537, pow(65537, -1, (p - 1) * (q - 1)))


def generate_key(algorithm: str) -> bytes:
    return secrets.token_bytes(int(re.search(r"\d+", algorithm)[0]) // 8)


def generate_iv(algorithm: str) -> bytes:
    return secrets.token_bytes(12 if algorithm.endswith("gcm") else 16)


def _padded(data: bytes, hash_: str, size: int) -> bytes:
    t = _DER[hash_] + hashlib.new(hash_, data).digest()
    return b"\x00\x01" + b"\xff" * (size - len(t) - 3) + b"\x00" + t


def sign(data: bytes, key, algorithm: str = "rsa_sha256") -> bytes:
    kind, _, hash_ = algorithm.partition("_")
    if kind == "ecdsa":
        return ecdsa_sign(data, key)
    return pow(int.from_bytes(_padded(data, hash_, key.size)), key.d, key.n).to_bytes(key.size)


def verify(data: bytes, signature: bytes, key, algorithm: str = "rsa_sha256") -> bool:
    kind, _, hash_ = algorithm.partition("_")
    if kind == "ecdsa":
        return ecdsa_verify(data, signature, key)
    if len(signature) != key.size or (s := int.from_bytes(signature)) >= key.n:
        return False
    return hmac.compare_digest(pow(s, key.e, key.n).to_bytes(key.size), _padded(data, hash_, key.size))


def _mask(seed: bytes, n: int) -> bytes:
    return b"".join(hashlib.sha1(seed + i.to_bytes(4)).digest() for i in range(-(-n // 20)))[:n]


def _xor(a: bytes, b: bytes) -> bytes:
    return bytes(x ^ y for x, y in zip(a, b, strict=True))


def encrypt_key(key: bytes, public: PublicKey) -> bytes:
    """RSA-OAEP with SHA-1 and MGF1."""
    k = public.size
    if len(key) > k - 42:
        raise ValueError("the key is too long for this modulus")
    block = hashlib.sha1(b"").digest() + b"\x00" * (k - len(key) - 42) + b"\x01" + key
    seed = secrets.token_bytes(20)
    masked = _xor(block, _mask(seed, len(block)))
    m = b"\x00" + _xor(seed, _mask(masked, 20)) + masked
    return pow(int.from_bytes(m), public.e, public.n).to_bytes(k)


def decrypt_key(data: bytes, private: PrivateKey) -> bytes:
    m = pow(int.from_bytes(data), private.d, private.n).to_bytes(private.size)
    masked = m[21:]
    block = _xor(masked, _mask(_xor(m[1:21], _mask(masked, 20)), len(masked)))
    at = block.find(b"\x01", 20)
    if m[0] or block[:20] != hashlib.sha1(b"").digest() or at < 0 or block[20:at].strip(b"\x00"):
        raise ValueError("the key can't be decrypted")
    return block[at + 1 :]


# DER and PEM


def _der(data: bytes, at: int = 0) -> tuple[int, bytes, int]:
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        size = n & 0x7F
        n, at = int.from_bytes(data[at : at + size]), at + size
    return tag, data[at : at + n], at + n


def _integers(body: bytes) -> list[int]:
    out, at = [], 0
    while at < len(body):
        tag, v, at = _der(body, at)
        if tag == 2:
            out.append(int.from_bytes(v, signed=True))
    return out


def parse_pem(text: str) -> PublicKey | PrivateKey:
    """An RSA key: PKCS#1 or PKCS#8, public or private."""
    m = re.search(r"-----BEGIN ([A-Z ]+)-----(.*?)-----END \1-----", text, re.S)
    if not m:
        raise ValueError("no PEM block")
    body = _der(base64.b64decode("".join(m[2].split())))[1]
    if m[1] in ("PUBLIC KEY", "PRIVATE KEY"):
        at, inner = 0, b""
        while at < len(body):
            tag, v, at = _der(body, at)
            if tag in (3, 4):
                inner = v[1:] if tag == 3 else v
        body = _der(inner)[1]
    numbers = _integers(body)
    return PublicKey(numbers[0], numbers[1]) if "PUBLIC" in m[1] else PrivateKey(numbers[1], numbers[2], numbers[3])


def _tlv(tag: int, body: bytes) -> bytes:
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8)) + body


def to_pem(key: PublicKey) -> str:
    """The public part, as PKCS#1."""
    body = _tlv(0x30, b"".join(_tlv(2, x.to_bytes(x.bit_length() // 8 + 1)) for x in (key.n, key.e)))
    return "-----BEGIN RSA PUBLIC KEY-----\n" + base64.encodebytes(body).decode() + "-----END RSA PUBLIC KEY-----\n"


# ECDSA on P-256 (fixed values: the curve)

_P = 2**256 - 2**224 + 2**192 + 2**96 - 1
_N = 0xFFFFFFFF00000000FFFFFFFFFFFFFFFFBCE6FAADA7179E84F3B9CAC2FC632551
_G = (0x6B17D1F2E12C4247F8BCE6E563A440F277037D812DEB33A0F4A13945D898C296, 0x4FE342E2FE1A7F9B8EE7EB4A7C0F9E162BCE33576B315ECECBB6406837BF51F5)


def _add(a, b):
    if a is None or b is None:
        return a or b
    if a[0] == b[0]:
        if (a[1] + b[1]) % _P == 0:
            return None
        m = (3 * a[0] * a[0] - 3) * pow(2 * a[1], -1, _P)
    else:
        m = (b[1] - a[1]) * pow(b[0] - a[0], -1, _P)
    x = (m * m - a[0] - b[0]) % _P
    return x, (m * (a[0] - x) - a[1]) % _P


def _times(k: int, point):
    out = None
    while k:
        if k & 1:
            out = _add(out, point)
        point, k = _add(point, point), k >> 1
    return out


def generate_ec() -> tuple[int, tuple[int, int]]:
    """(private, public)."""
    d = secrets.randbelow(_N - 1) + 1
    return d, _times(d, _G)


def ecdsa_sign(data: bytes, d: int) -> bytes:
    z = int.from_bytes(hashlib.sha256(data).digest())
    while True:
        k = secrets.randbelow(_N - 1) + 1
        r = _times(k, _G)[0] % _N
        s = pow(k, -1, _N) * (z + r * d) % _N
        if r and s:
            return r.to_bytes(32) + s.to_bytes(32)


def ecdsa_verify(data: bytes, signature: bytes, public) -> bool:
    r, s = int.from_bytes(signature[:32]), int.from_bytes(signature[32:])
    if len(signature) != 64 or not (0 < r < _N and 0 < s < _N):
        return False
    z, w = int.from_bytes(hashlib.sha256(data).digest()), pow(s, -1, _N)
    p = _add(_times(z * w % _N, _G), _times(r * w % _N, public))
    return p is not None and p[0] % _N == r


# documents


def _stream(xml: str) -> list[Event]:
    out = events(xml.encode(), ParserConfig(markers=False))
    for e in out:
        if e.kind == "error":
            raise ValueError(f"{e.error[1]}: {e.error[2]}")
    return out


def _find(stream: list[Event], uri: str, local: str, after: int = 0) -> int:
    return next((k for k in range(after, len(stream)) if stream[k].kind == "start_element" and stream[k].name.rpartition(":")[2] == local and stream[k].ns.resolve(stream[k].name.rpartition(":")[0]) == uri), -1)


def _by_id(stream: list[Event], value: str) -> int:
    return next((k for k, e in enumerate(stream) if e.kind == "start_element" and any(n in ("Id", "ID", "id", "xml:id") and v == value for n, v in e.attrs)), -1)


def _attr(e: Event, name: str) -> str | None:
    return next((v for n, v in e.attrs if n == name), None)


def _text(part: list[Event]) -> str:
    return "".join(e.content for e in part if e.kind in ("characters", "cdata"))


def _span(xml: bytes, stream: list[Event], k: int) -> tuple[int, int]:
    """The bytes of the element that starts at event k."""
    part = c14n.subtree(stream, k)
    end = xml.index(b">", part[-1].pos) + 1 if part[-1].pos != part[0].pos else _tag_end(xml, part[0].pos)
    return part[0].pos - 1, end


def _tag_end(xml: bytes, at: int) -> int:
    quote = None
    while True:
        c = xml[at : at + 1]
        if quote:
            quote = None if c == quote else quote
        elif c in (b'"', b"'"):
            quote = c
        elif c == b">":
            return at + 1
        at += 1


def _referenced(stream: list[Event], uri: str) -> list[Event]:
    if uri == "":
        return stream
    if not uri.startswith("#"):
        raise ValueError("external references are not followed")
    k = _by_id(stream, uri[1:])
    if k < 0:
        raise ValueError(f"nothing has the id {uri[1:]}")
    return c14n.subtree(stream, k)


def _without_signature(part: list[Event], signature: list[Event]) -> list[Event]:
    gone = set(map(id, signature))
    return [e for e in part if id(e) not in gone]


def sign_document(xml: str, key, algorithm: str = "rsa_sha256", hash_: str = "sha256", how: str = "exc_c14n", kind: str = "enveloped", uri: str = "") -> str:
    """``enveloped`` puts the signature before the root's end tag, ``enveloping`` puts the document into it,
    and ``detached`` gives the signature alone."""
    xml = re.sub(r"\r\n?", "\n", xml)
    if kind == "enveloping":
        body = c14n.canonicalize(xml, how)
        inner, target = f'<ds:Object xmlns:ds="{DS}" Id="object">{body}</ds:Object>', "#object"
        data = c14n.canonicalize(inner, how)
    else:
        inner, target = "", uri
        data = c14n.canonical_events(_referenced(_stream(xml), uri), how)
    transforms = [URIS["enveloped"]] * (kind == "enveloped") + [URIS[how]]
    value = base64.b64encode(hashlib.new(hash_, data.encode()).digest()).decode()
    info = (
        f'<ds:SignedInfo xmlns:ds="{DS}"><ds:CanonicalizationMethod Algorithm="{URIS[how]}"></ds:CanonicalizationMethod><ds:SignatureMethod Algorithm="{URIS[algorithm]}"></ds:SignatureMethod>'
        f'<ds:Reference URI="{c14n.escape_attr(target)}"><ds:Transforms>{"".join(f"""<ds:Transform Algorithm="{t}"></ds:Transform>""" for t in transforms)}</ds:Transforms>'
        f'<ds:DigestMethod Algorithm="{URIS[hash_]}"></ds:DigestMethod><ds:DigestValue>{value}</ds:DigestValue></ds:Reference></ds:SignedInfo>'
    )
    signed = base64.b64encode(sign(c14n.canonicalize(info, how).encode(), key, algorithm)).decode()
    whole = f'<ds:Signature xmlns:ds="{DS}">{info.replace(f""" xmlns:ds="{DS}\"""", "", 1)}<ds:SignatureValue>{signed}</ds:SignatureValue>{inner.replace(f""" xmlns:ds="{DS}\"""", "", 1)}</ds:Signature>'
    if kind != "enveloped":
        return whole
    b = xml.encode()
    at = b.rindex(b"</")
    return (b[:at] + whole.encode() + b[at:]).decode()


def signature_info(xml: str) -> dict | None:
    """What the first signature says of itself; None without one."""
    stream = _stream(xml)
    k = _find(stream, DS, "Signature")
    if k < 0:
        return None
    part = c14n.subtree(stream, k)
    get = lambda local, name="Algorithm": next((_attr(e, name) for e in part if e.kind == "start_element" and e.name.rpartition(":")[2] == local), None)
    return {"signature_algorithm": name_of(get("SignatureMethod") or ""), "c14n_algorithm": name_of(get("CanonicalizationMethod") or ""), "digest_algorithm": name_of(get("DigestMethod") or ""), "references": [_attr(e, "URI") for e in part if e.kind == "start_element" and e.name.rpartition(":")[2] == "Reference"]}


def missing_parts(xml: str) -> list[str]:
    """Elements that a signature must have and the first one lacks."""
    stream = _stream(xml)
    k = _find(stream, DS, "Signature")
    have = {e.name.rpartition(":")[2] for e in c14n.subtree(stream, k) if e.kind == "start_element"} if k >= 0 else set()
    return [x for x in ("SignedInfo", "CanonicalizationMethod", "SignatureMethod", "Reference", "DigestMethod", "DigestValue", "SignatureValue") if x not in have]


def verify_document(xml: str, key, detached: str | None = None) -> tuple[bool, str]:
    """(valid, reason). ``detached``: the document that a detached signature signs."""
    try:
        stream = _stream(re.sub(r"\r\n?", "\n", xml))
        k = _find(stream, DS, "Signature")
        if k < 0:
            return False, "no_signature"
        signature = c14n.subtree(stream, k)
        at = _find(signature, DS, "SignedInfo")
        info = c14n.subtree(signature, at)
        algorithm = lambda local: name_of(next(_attr(e, "Algorithm") for e in info if e.kind == "start_element" and e.name.rpartition(":")[2] == local))
        outer = _stream(re.sub(r"\r\n?", "\n", detached)) if detached is not None else stream
        r, n = -1, 0
        while (r := _find(info, DS, "Reference", r + 1)) >= 0:
            n += 1
            ref = c14n.subtree(info, r)
            part, how, data = _referenced(outer, _attr(ref[0], "URI") or ""), "c14n", None
            for e in ref:
                if e.kind == "start_element" and e.name.rpartition(":")[2] == "Transform":
                    t = name_of(_attr(e, "Algorithm"))
                    if t == "enveloped":
                        part = _without_signature(part, signature)
                    elif t == "base64":
                        data = base64.b64decode(_text(part))
                    elif t in c14n.URIS:
                        how = t
                    else:
                        return False, "unknown_transform"
            data = c14n.canonical_events(part, how).encode() if data is None else data
            hash_ = name_of(next(_attr(e, "Algorithm") for e in ref if e.kind == "start_element" and e.name.rpartition(":")[2] == "DigestMethod"))
            stated = base64.b64decode(_text(c14n.subtree(ref, _find(ref, DS, "DigestValue"))))
            if not hmac.compare_digest(hashlib.new(hash_, data).digest(), stated):
                return False, "digest_mismatch"
        if not n:  # a signature of nothing says nothing of the document
            return False, "no_reference"
        value = base64.b64decode(_text(c14n.subtree(signature, _find(signature, DS, "SignatureValue"))))
        signed = c14n.canonical_events(info, algorithm("CanonicalizationMethod")).encode()
        return (True, "valid") if verify(signed, value, key, algorithm("SignatureMethod")) else (False, "signature_mismatch")
    except (ValueError, StopIteration, TypeError) as e:
        return False, f"error: {e}"


def plain_part(xml: str, ref: str, kind: str = "element") -> tuple[bytes, bytes, bytes]:
    """Of the element with the id in ``ref`` (``#id``): what comes before it, what is to be encrypted, what
    comes after. With kind ``content`` its tags stay outside."""
    b = xml.encode()
    stream = _stream(xml)
    k = _by_id(stream, ref.removeprefix("#"))
    if k < 0:
        raise ValueError(f"nothing has the id {ref}")
    s, e = _span(b, stream, k)
    if kind == "content":
        s, e = _tag_end(b, s), b.rindex(b"</", s, e)
    return b[:s], b[s:e], b[e:]


def encrypted_data(cipher: bytes, algorithm: str, kind: str = "element", id_: str | None = None, wrapped: bytes | None = None, transport: str = "rsa_oaep") -> str:
    key = f'<ds:KeyInfo xmlns:ds="{DS}"><xenc:EncryptedKey><xenc:EncryptionMethod Algorithm="{URIS[transport]}"/><xenc:CipherData><xenc:CipherValue>{base64.b64encode(wrapped).decode()}</xenc:CipherValue></xenc:CipherData></xenc:EncryptedKey></ds:KeyInfo>' if wrapped else ""
    own = f' Id="{c14n.escape_attr(id_)}"' if id_ else ""
    return f'<xenc:EncryptedData xmlns:xenc="{XENC}"{own} Type="{XENC}{kind.capitalize()}"><xenc:EncryptionMethod Algorithm="{URIS[algorithm]}"/>{key}<xenc:CipherData><xenc:CipherValue>{base64.b64encode(cipher).decode()}</xenc:CipherValue></xenc:CipherData></xenc:EncryptedData>'


def encrypted_list(xml: str) -> list[dict]:
    """Id, type, algorithm, cipher value and wrapped key of each EncryptedData, with the bytes it takes up."""
    b, out, k = xml.encode(), [], -1
    stream = _stream(xml)
    while (k := _find(stream, XENC, "EncryptedData", k + 1)) >= 0:
        part = c14n.subtree(stream, k)
        wrap = _find(part, XENC, "EncryptedKey")
        inner = c14n.subtree(part, wrap) if wrap >= 0 else []
        own = [e for e in part if id(e) not in set(map(id, inner))]
        value = lambda p: base64.b64decode(_text(c14n.subtree(p, _find(p, XENC, "CipherValue"))))
        method = lambda p: name_of(_attr(p[_find(p, XENC, "EncryptionMethod")], "Algorithm") or "")
        s, e = _span(b, stream, k)
        out.append({"id": _attr(part[0], "Id"), "type": (_attr(part[0], "Type") or "").rpartition("#")[2].lower(), "algorithm": method(own), "cipher": value(own), "wrapped": value(inner) if inner else None, "start": s, "end": e})
    return out
