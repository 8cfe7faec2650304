"""Each reason of a break planted and found; hashes and signatures against plain Python and the published vector."""

import base64
import hashlib
import json

import pytest

from palimpsest.operators import audit_log as A

SECRET = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
PUBLIC = bytes.fromhex("d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a")


def packed(point):
    x, y, z, _ = point
    inverse = pow(z, -1, A._P)
    x, y = x * inverse % A._P, y * inverse % A._P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def sign(message, secret=SECRET):
    h = hashlib.sha512(secret).digest()
    a = int.from_bytes(h[:32], "little") & ((1 << 254) - 8) | 1 << 254
    public = packed(A._times(a, A._BASE))
    r = int.from_bytes(hashlib.sha512(h[32:] + message).digest(), "little") % A._Q
    big_r = packed(A._times(r, A._BASE))
    k = int.from_bytes(hashlib.sha512(big_r + public + message).digest(), "little") % A._Q
    return big_r + ((r + k * a) % A._Q).to_bytes(32, "little")


def test_published_vector():
    signature = bytes.fromhex("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b")
    assert sign(b"") == signature and A.verify_signature(PUBLIC, b"", signature)
    assert not A.verify_signature(PUBLIC, b"x", signature) and not A.verify_signature(PUBLIC, b"", signature[:32] + bytes(32)) and not A.verify_signature(bytes(32), b"", bytes(64))


def chain(n=4, chain_id="c", secret=SECRET, **extra):
    out, last = [], "a" * 64
    for i in range(1, n + 1):
        record = {"event": f"E{i % 2} é", "z": i, "a": [1.5, None], "chain_id": chain_id, "sequence": i, "previous_hash": last, "timestamp": f"2024-01-0{i}", **extra}
        if i == 1:
            record["initial_hash"] = last
        out.append(seal(record, secret))
        last = out[-1]["hash"]
    return out


def seal(record, secret=SECRET):
    record = {k: v for k, v in record.items() if k not in A.SIGNED}
    record["hash"] = hashlib.sha256(json.dumps(record).encode()).hexdigest()
    if secret:
        record["signature"] = base64.b64encode(sign(json.dumps(record).encode(), secret)).decode()
        record["public_key_fingerprint"] = hashlib.sha256(PUBLIC).hexdigest()
    return record


def changed(i, seal_again=True, **fields):
    rows = chain()
    rows[i] = {k: v for k, v in {**rows[i], **fields}.items() if v != "DROP"}
    if seal_again:
        rows[i] = seal(rows[i])
    return [json.dumps(r) for r in rows]


text = lambda rows: [json.dumps(r) for r in rows]
LOGS = {
    "good": (text(chain()), []),
    "blank": (["", *text(chain()), "  "], []),
    "duplicate": ([*text(chain(2)), '{"a": 1, "a": 2}'], [(3, "duplicate_json_key")]),
    "nested": ([*text(chain(2)), '{"a": {"b": 1, "b": 1}}'], [(3, "duplicate_json_key")]),
    "broken": ([*text(chain(2)), '{"a": '], [(3, "invalid_json")]),
    "scalar": ([*text(chain(2)), "[1]", '"x"'], [(3, "non_object_record"), (4, "non_object_record")]),
    "edited": (changed(1, False, z=9), [(2, "hash_mismatch"), (2, "invalid_signature")]),
    "unhashed": (changed(3, False, hash="DROP"), [(4, "missing_hash"), (4, "invalid_signature")]),
    "no chain": (changed(3, chain_id="DROP"), [(4, "missing_chain_id"), (4, "unanchored_chain_start"), (4, "non_initial_sequence_start")]),
    "odd chain": (changed(3, chain_id=7), [(4, "invalid_chain_id"), (4, "unanchored_chain_start"), (4, "non_initial_sequence_start")]),
    "gap": (text(chain()[:1] + chain()[2:]), [(2, "chain_discontinuity"), (2, "sequence_discontinuity")]),
    "headless": (text(chain()[1:]), [(1, "unanchored_chain_start"), (1, "non_initial_sequence_start")]),
    "no sequence": (changed(3, sequence="DROP"), [(4, "missing_sequence")]),
    "odd sequence": (changed(3, sequence=True), [(4, "invalid_sequence")]),
    "no print": (changed(3, False, public_key_fingerprint="DROP"), [(4, "missing_public_key_fingerprint")]),
    "no signature": (changed(3, False, signature="DROP"), [(4, "missing_signature"), (4, "unsigned_record")]),
    "odd print": (changed(3, False, public_key_fingerprint="XYZ"), [(4, "invalid_public_key_fingerprint")]),
    "other print": (changed(3, False, public_key_fingerprint="0" * 64), [(4, "public_key_fingerprint_mismatch")]),
    "odd signature": (changed(3, False, signature="###"), [(4, "invalid_signature_encoding")]),
    "unsigned": (text(chain(2, secret=None)), [(1, "unsigned_record"), (2, "unsigned_record")]),
    "forged": (text(chain(1, secret=bytes(32))), [(1, "invalid_signature")]),
    "empty": (["", ""], [(0, "empty_log")]),
    "two": (text(chain(2, "c") + chain(2, "d")), [(0, "multiple_chains_in_one_file")]),
}


@pytest.fixture(scope="module")
def logs(spark):
    lines = [(name, i, value) for name, (rows, _) in LOGS.items() for i, value in enumerate(rows, 1)]
    return spark.createDataFrame(lines, "source string, line long, value string").repartition(3)


def test_every_reason_is_found(spark, logs):
    got = {}
    for r in A.breaks(A.parsed(logs, PUBLIC), logs.select("source")).collect():
        got.setdefault(r.source, []).append((r.line, r.reason))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, (_, v) in LOGS.items() if v}
    assert len({reason for v in got.values() for _, reason in v}) == 22


def test_summaries_and_checkpoint(spark, logs):
    records = A.parsed(logs, PUBLIC)
    s = A.summary(records, A.breaks(records, logs.select("source")), True)
    rows = {r.source: r for r in s.collect()}
    good = chain()
    assert rows["good"].chain_valid and rows["good"].authentic and rows["good"].terminal_hash == good[-1]["hash"] and (rows["good"].first_sequence, rows["good"].last_sequence, rows["good"].total_events) == (1, 4, 4)
    assert {k for k, r in rows.items() if r.authentic} == {"good", "blank"} and rows["forged"].signatures_invalid == 1 and rows["empty"].total_events == 0
    fine = s.where("authentic")
    point = A.checkpoint(fine)
    assert point.first().refused is None and point.first().total_events == 8
    assert A.verify_checkpoint(point, fine).first().valid and not A.verify_checkpoint(point, fine.where("source = 'good'")).first().valid
    assert A.checkpoint(s).first().refused == min(k for k, r in rows.items() if not r.authentic)
    unkeyed = A.parsed(logs)
    assert not A.breaks(unkeyed).where("source in ('unsigned', 'forged', 'good')").count() and not A.summary(unkeyed, A.breaks(unkeyed), False).where("authentic").count()


def test_lines_of_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(LOGS["good"][0]) + "\n")
    (tmp_path / "b.jsonl").write_text("\r\n".join(LOGS["edited"][0]))
    lines = A.lines_of(spark, str(tmp_path))
    found = A.breaks(A.parsed(lines, PUBLIC)).collect()
    assert sorted((r.source[-7:], r.line, r.reason) for r in found) == [("b.jsonl", 2, "hash_mismatch"), ("b.jsonl", 2, "invalid_signature")]
