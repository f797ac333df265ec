"""Cases that the operators once left out."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from lumenframe.llm import ctw, lines, secrets

HEAD = "one header line that every listing repeats"


def test_short_lines_in_the_pipeline(spark):
    docs = spark.createDataFrame([(1, "Les.\n\nfirst"), (2, "Les.\n\nsecond"), (3, "third\nLes.\nthird"), (4, "Les.")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.stage(spark, docs, "").collect()}
    assert got == {1: "Les.\n\nfirst", 2: "\nsecond", 3: "third"}


def test_documents_keep_what_is_left(spark):
    texts = [HEAD, f"{HEAD}\n- own", f"{HEAD}\n \t", None, "", f"{HEAD}\n\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.stage(spark, docs, "").collect()}
    assert got == {0: HEAD, 1: "- own", 3: None, 4: ""}


def test_ctw_tells_order_beyond_five_bytes():
    text = lambda tail: np.frombuffer(tail, np.uint8)
    a, b = (ctw.runs(text(t), np.array([0, len(t)]))[-1] for t in (b"xabcdef!", b"yabcdef!"))
    assert a != b


def test_ctw_texts_before_an_empty_one(spark):
    texts = ["abc", "abc", "", None, "abc", ""]
    for rows in (texts, texts[:2] + texts[4:5]):
        docs = spark.createDataFrame([(0, t) for t in rows], "doc_id long, text string").repartition(1)
        got = [r.bits for r in ctw.score(docs).collect() if r.n_bytes]
        assert len(got) == 3 and max(got) - min(got) < 1e-9
    run, cost = ctw._distinct(pa.table({"text": ["abc"]}))[0], np.array([1.0, 2.0, 3.0])
    none = ctw.packed(np.zeros(0, np.int64))
    rows = [{"part": 0, "bucket": 0, "bits": ctw.packed(cost[at].astype(np.float32)), "more": 0, "places": none, "owns": none, "more_bits": none} for _, at in ctw._by_bucket(run, 1)]
    made = ctw._scored(pa.table({"doc_id": [1, 2], "text": ["abc", ""]}), pa.Table.from_pylist(rows), np.array([0]), pa.int64())
    assert made["bits"].to_pylist() == [6.0, 0.0]


@pytest.mark.parametrize(
    ("text", "name", "value"),
    [
        ('conn = "Server=db;Password=Xy12ab34"', "Password", "Xy12ab34"),
        ('command: "mysql --password=S3cr3tPa55"', "password", "S3cr3tPa55"),
        ('config = """\nuser: bob\npassword: hunter2hunter\n"""\nx = 1', "password", "hunter2hunter"),
        ('body = "{\\"client_secret\\": \\"Zx8!kd93ksLq\\"}"', "client_secret", "Zx8!kd93ksLq"),
        ("env = `TOKEN='a1b2c3d4e5f6a7b8'`", "TOKEN", "a1b2c3d4e5f6a7b8"),
        ('password = "letmeinplease"', "password", "letmeinplease"),
    ],
)
def test_secrets_in_quoted_text(text, name, value):
    ((n, v, start, stop, _),) = secrets.secrets(text)
    assert (n, v) == (name, value) and value in text[start:stop]


@pytest.mark.parametrize(
    ("text", "name", "value"),
    [
        ('secret = ("abc123"' + " " * 250 + '"def456ghi")', "secret", "abc123def456ghi"),
        ('{"' + "k" * 2000 + '_password": "a1B!xyz9"}', "k" * 2000 + "_password", "a1B!xyz9"),
        ('password = "a1B!x"', "password", "a1B!x"),
        ("password = 'aaaa1111'", "password", "aaaa1111"),
        ("PASSWORD=x=y9Zq!", "PASSWORD", "x=y9Zq!"),
        ("http://x.y/?user=bob&password=S3cr3tPa55&x=1", "password", "S3cr3tPa55"),
        ("a" * 3000 + " api_key: " + " " * 2000 + "str = 'Zx81kd93ksLq'", "api_key", "Zx81kd93ksLq"),
    ],
)
def test_secrets_of_any_length(text, name, value):
    ((n, v, start, stop, _),) = secrets.secrets(text)
    assert (n, v) == (name, value)


def test_constants_that_outgrow_their_text():
    bomb = "A0=x1\n" + "\n".join(f"A{i}=${{A{i - 1}}}${{A{i - 1}}}" for i in range(1, 60)) + '\npassword = "${A2}-zz"'
    assert [(n, v) for n, v, *_ in secrets.secrets(bomb)] == [("password", "x1x1x1x1-zz")]


def test_secrets_of_generated_programs():
    """Programs of a small grammar, with the pairs that they were made of."""
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    forms = {
        "ini": lambda n, v: f"{n} = {v}", "env": lambda n, v: f"export {n}={v}", "yaml": lambda n, v: f"  {n}: {v}", "json": lambda n, v: f'  "{n}": "{v}",', "typed": lambda n, v: f"{n}: str = '{v}'",
        "ruby": lambda n, v: f':x => 1, "{n}" => "{v}"', "go": lambda n, v: f'{n} := "{v}"', "item": lambda n, v: f'config["{n}"] = "{v}"', "triple": lambda n, v: f'{n} = """{v}"""', "added": lambda n, v: f'{n} = "{v[:5]}" + "{v[5:]}"',
        "split": lambda n, v: f'{n} = ("{v[:7]}"\n    "{v[7:]}")', "inner": lambda n, v: f'run("tool --{n}={v} --fast")', "args": lambda n, v: f"opts = 'host=db;{n}={v}'",
    }
    for _ in range(300):
        lines, want = [], []
        for _ in range(rng.randint(1, 8)):
            kind = rng.random()
            if kind < 0.5:
                name, value = rng.choice(["password", "db_password", "apiToken", "CLIENT_SECRET", "auth.token"]), word(rng.randint(10, 40)) + "9aZ"
                form = rng.choice([k for k in forms if k not in ("go", "typed", "ruby") or "." not in name])
                lines.append(forms[form](name, value))
                want.append((name, value))
            elif kind < 0.7:
                a, value = "part" + word(6), word(12) + "7bQ"
                lines += [f'{a} = "{value}"', f'SECRET = {a} + "-end"']
                want.append(("SECRET", f"{value}-end"))
            else:
                lines.append(rng.choice(["for i in range(10): pass", 'title = "a plain sentence of words"', "count: 12", "if password == other:", "# a note", "x = f(y)", "path = '/usr/lib/x'"]))
        assert [(n, v) for n, v, *_ in secrets.secrets("\n".join(lines))] == want, "\n".join(lines)


def test_secrets_with_ties_and_repeats(spark):
    text = 'token = "24be64439e3e49cf46b2d7c90f3602a3"; a = "Password=Xy12ab34"'
    docs = spark.createDataFrame([("a", text), ("a", text), ("b", None), (None, text)], "doc_id string, text string").selectExpr("*", "'x' as name", "1 as start", "2.0D as score")
    got = sorted((r.doc_id or "", r.name, r.literal) for r in secrets.scan(docs).collect())
    assert got == sorted((i, n, v) for i in ("a", "a", "") for n, v in (("token", "24be64439e3e49cf46b2d7c90f3602a3"), ("Password", "Xy12ab34")))
