import difflib
import uuid

from pyspark.sql import functions as F

from palimpsest.functions import encoded, synthetic
from palimpsest.operators import agents, mutation, reports


def test_loops_by_text_and_numbers(spark):
    a = "the agent asks for the very same page again and again, page number "
    rows = [("s", 1, a + "x", []), ("s", 2, a + "y", []), ("s", 3, a + "y", []), ("t", 1, a + "1", []), ("t", 2, a + "2", []), ("u", 1, None, ["f:1"]), ("u", 2, "short", ["f:1"])]
    got = {(r.session, r.turn): (r.run, r.tripped) for r in agents.loops(spark.createDataFrame(rows, "session string, turn int, payload string, calls array<string>")).collect()}
    assert difflib.SequenceMatcher(None, a + "x", a + "y").quick_ratio() > 0.95
    assert got == {("s", 1): (0, False), ("s", 2): (1, False), ("s", 3): (2, True), ("t", 1): (0, False), ("t", 2): (0, False)}


def test_same_characters_in_another_order_are_no_loop(spark):
    """Events 669645 and 670997: their payloads hold nearly the same characters, in digests that have nothing to do with each other."""
    import hashlib

    texts = [chr(97 + i % 26) * (60 + i % 7) + hashlib.md5(str(i).encode()).hexdigest() for i in (669645, 670997)]
    assert difflib.SequenceMatcher(None, *texts).quick_ratio() > 0.95
    turns = spark.createDataFrame([("s", 1, texts[0], ["view"]), ("s", 2, texts[1], ["click"])], "session string, turn int, payload string, calls array<string>")
    assert [(r.run, r.tripped) for r in agents.loops(turns).orderBy("turn").collect()] == [(0, False), (0, False)]


def test_mutation_round_trip_and_errors(spark):
    rows = [(1, '{"id": "k@example.com", "a": {"id": "k@example.com", "b": ["m@example.com", 1]}}'), (2, '{"a": "z@example.com", "_ctx_hash_a": 1}'), (3, None), (4, "{"), (5, "[" * 50 + "]" * 50)]
    df = spark.createDataFrame(rows, "payload_id long, payload string")
    key = mutation.session_key(b"secret", b"salt", F.lit("vk|s"))
    done = mutation.mutate(df, key, b"seed").select("payload_id", "mutated", F.col("error").alias("failed"))
    back = {r.payload_id: r for r in mutation.unmutate(done, key, payload="mutated").collect()}
    assert [back[i].failed for i in range(1, 6)] == [None, "reserved_field", "null", "bad_json", "too_deep"]
    assert back[1].restored == rows[0][1] and back[1].mutated.count("k@example.com") == 1 and "m@example.com" not in back[1].mutated
    other = mutation.unmutate(done, mutation.session_key(b"secret", b"salt", F.lit("vk|t")), payload="mutated").where("payload_id = 1").first()
    assert "m@example.com" not in other.restored


def test_stand_ins_are_distinct_in_their_session(spark):
    v = spark.range(60).select(F.lit("s").alias("session"), F.col("id").cast("string").alias("original"), F.lit("PERSON").alias("entity_type"), F.col("id").cast("int").alias("ordinal"), F.format_string("[PERSON_%d]", "id").alias("token"))
    got = [r.synthetic for r in synthetic.synthesize(v, b"k").collect()]
    assert len(set(got)) == 60 and set(synthetic.GIVEN) & set(got)


def test_encoded_values_nested_and_long(spark):
    import base64

    twice = base64.b64encode(base64.b64encode(b"mail me@example.com")).decode()
    long = base64.b64encode(b"x" * 9000 + b" me@example.com").decode()
    df = spark.createDataFrame([(1, twice), (2, long), (3, "AAAAAAAAAAAA"), (4, None), (5, ""), (6, "me&#64;example&period;com")], "id long, t string")
    d = encoded.with_entity_spans(df, "t").select("id", F.size(encoded.base64_spans(F.col("t"))).alias("b"), F.size("entity_spans").alias("e"))
    assert {r.id: (r.b, r.e) for r in d.collect()} == {1: (1, 0), 2: (1, 0), 3: (0, 0), 4: (0, 0), 5: (0, 0), 6: (0, 1)}


def test_uuid_and_runs(spark):
    space = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    r = spark.createDataFrame([("a/b", "123-45", "x 23-4 y"), ("é", "", "t")], "n string, v string, t string").select("n", reports.uuid5(space, F.col("n")).alias("u"), reports.longest_run(F.col("v"), F.col("t")).alias("k")).collect()
    assert [x.u for x in r] == [str(uuid.uuid5(uuid.UUID(space), x.n)) for x in r] and [x.k for x in r] == [4, 0]
