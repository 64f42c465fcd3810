"""XML Signature and XML Encryption over a column of documents."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import security as S
from .documents import per_document


def sign(docs: DataFrame, key, text: str = "xml", **how) -> DataFrame:
    """(doc_id, xml): each document signed."""
    return per_document(docs, lambda b: [{"xml": S.sign_document(b.decode(), key, **how)}], "xml string", text)


def verify(docs: DataFrame, key, text: str = "xml") -> DataFrame:
    """(doc_id, valid, reason)."""

    def one(b: bytes) -> list[dict]:
        ok, why = S.verify_document(b.decode(), key)
        return [{"valid": ok, "reason": why}]

    return per_document(docs, one, "valid boolean, reason string", text)


def signature_info(docs: DataFrame, text: str = "xml") -> DataFrame:
    def one(b: bytes) -> list[dict]:
        info = S.signature_info(b.decode())
        return [{**(info or {"signature_algorithm": None, "c14n_algorithm": None, "digest_algorithm": None, "references": None}), "missing": S.missing_parts(b.decode())}]

    return per_document(docs, one, "signature_algorithm string, c14n_algorithm string, digest_algorithm string, references array<string>, missing array<string>", text)


def encrypt(docs: DataFrame, ref: str, key: bytes, algorithm: str = "aes256_gcm", kind: str = "element", public: S.PublicKey | None = None, text: str = "xml") -> DataFrame:
    """(doc_id, xml): the element with the id replaced by its encryption. Python finds the place, Spark's own
    AES encrypts. With ``public`` the key goes along, wrapped."""

    def cut(b: bytes) -> list[dict]:
        return [dict(zip(("before", "plain", "after"), S.plain_part(b.decode(), ref, kind), strict=True))]

    wrapped = S.encrypt_key(key, public) if public else None
    parts = per_document(docs, cut, "before binary, plain binary, after binary", text)
    done = parts.select("doc_id", "before", S.encrypt(F.col("plain"), F.lit(key), algorithm).alias("cipher"), "after")

    def put(batches):
        for batch in batches:
            d, before, cipher, after = (c.to_pylist() for c in batch.columns)
            xml = [(x + S.encrypted_data(y, algorithm, kind, wrapped=wrapped).encode() + z).decode() for x, y, z in zip(before, cipher, after, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(d, batch.column(0).type), pa.array(xml, pa.string())], ["doc_id", "xml"])

    return done.mapInArrow(put, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, xml string")


def encrypted_parts(docs: DataFrame, text: str = "xml") -> DataFrame:
    """A row for each EncryptedData: doc_id, place, id, type, algorithm, cipher, wrapped, start and end bytes."""
    schema = "place int, id string, type string, algorithm string, cipher binary, wrapped binary, start long, end long"
    return per_document(docs, lambda b: [{"place": k, **x} for k, x in enumerate(S.encrypted_list(b.decode()))], schema, text)


#: Unwrapped keys that a task remembers.
KEYS = 4096


def decrypt(docs: DataFrame, key: bytes | None = None, private: S.PrivateKey | None = None, text: str = "xml") -> DataFrame:
    """(doc_id, xml): every EncryptedData replaced by what it holds, with the key given or its own, unwrapped. Each
    document is read once, where it stands; a wrapped key that comes again isn't unwrapped again."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    part = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("algorithm", pa.string()), ("cipher", pa.binary()), ("key", pa.binary())])

    def find(batches):
        unwrap = lru_cache(KEYS)(lambda w: S.decrypt_key(w, private))

        def own(x: dict) -> bytes | None:
            return key if key is not None else unwrap(x["wrapped"]) if x["wrapped"] is not None else None

        for batch in batches:
            parts = [[{**{k: x[k] for k in ("start", "end", "algorithm", "cipher")}, "key": own(x)} for x in S.encrypted_list((b or b"").decode())] for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.list_(part))], ["doc_id", "b", "parts"])

    both = docs.select("doc_id", F.col(text).cast("binary").alias("b")).mapInArrow(find, f"doc_id {kind}, b binary, parts array<struct<start:long,end:long,algorithm:string,cipher:binary,key:binary>>")
    plain = lambda p: F.when(p["algorithm"].endswith("gcm"), S.decrypt(p["cipher"], p["key"], "aes_gcm")).otherwise(S.decrypt(p["cipher"], p["key"], "aes_cbc"))
    end = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("parts", i - 1)["end"])
    pieces = F.transform("parts", lambda p, i: F.concat(F.substr("b", (end(i) + 1).cast("int"), (p["start"] - end(i)).cast("int")), plain(p)))
    rest = F.substr("b", (F.get("parts", F.size("parts") - 1)["end"] + 1).cast("int"), F.octet_length("b"))
    whole = F.concat(F.aggregate(pieces, F.lit(b""), lambda acc, x: F.concat(acc, x)), rest)
    return both.select("doc_id", F.when(F.size("parts") > 0, whole).otherwise(F.col("b")).cast("string").alias("xml"))
