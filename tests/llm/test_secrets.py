import hashlib
import random
import re
import time

import pytest
from marginalia.llm import queries, secrets


def base(text):
    found = []
    pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    pattern = re.sub("[a-z](?=[^\\]]*\\|)|(?<=\\?)[a-z]", lambda m: m[0], pattern)
    either = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)")
    pattern = either + pattern[pattern.index(")") + 1 :]
    found += [("assign", m.start(), m.end()) for m in re.finditer(pattern, text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


@pytest.mark.parametrize(
    "text, want",
    [
        ('db_pwd = "hunter22x"', ["hunter22x"]),
        ("const K = 'zx81Qp77!'\nclient_credentials: K\n", ["zx81Qp77!"]),
        ("A = 'q9w8e7r6t5'\nB = A\nauth_bearer = B", ["q9w8e7r6t5"]),
        ("signing_key := SOURCE\nSOURCE = 'a8b7c6d5'", ["a8b7c6d5"]),
        ("privateKey: str = 'k3y-a1b2-z9'", ["k3y-a1b2-z9"]),
        ("<access_key>ab12cd34</access_key>", ["ab12cd34"]),
        ('"private.key" => "m1n2b3v4"', ["m1n2b3v4"]),
        ("export DB_PASSPHRASE=tr0ub4dor", ["tr0ub4dor"]),
        ("colour = 'a8b7c6d5'", []),
        ("pwd = 'changeme1'", []),
        ("private_key == 'a8b7c6d5'", []),
        ("The key: a door. Access: https://x.y/z1", []),
        ("pwd = ${SECRET_9}", []),
        (r'db_pwd = "ab12\"cd34ef99xy"', [r'ab12\"cd34ef99xy']),
        ('db_pwd = """zK39qLw82mXp"""', ["zK39qLw82mXp"]),
        ("db_pwd: |\n  zK39qLw82mXp\nother: 1", ["zK39qLw82mXp"]),
        ("a:\n  db_pwd: >-\n    zK39qL\n\n    w82mXp\n  b: 1", ["zK39qL\n\n    w82mXp"]),
        ("db_pwd = \\\n    'zK39qLw82mXp'", ["zK39qLw82mXp"]),
        ("db_pwd =\n    'zK39qLw82mXp'", ["zK39qLw82mXp"]),
        ("db_pwd = (\n  'zK39qL'\n  'w82mXp'\n)", ["zK39qL", "w82mXp"]),
        ('db_pwd = "zK39qL" + "w82mXp77"', ["zK39qL", "w82mXp77"]),
        ("$db_pwd = 'zK39qL' . 'w82mXp77';", ["zK39qL", "w82mXp77"]),
        ("A = 'zK39qL'\npwd = A + 'w82mXp77'", ["zK39qL", "w82mXp77"]),
        ("a = pwd = 'zK39qLw82'", ["zK39qLw82"]),
        ('{"passphrase": {"value": "zK39qLw82"}, "size": {"value": "zK39qLw83"}}', ["zK39qLw82"]),
        ("credentials:\n  value: zK39qLw82\nplain:\n  value: zK39qLw83", ["zK39qLw82"]),
        ('os.environ["DB_PWD"] = "zK39qLw82"', ["zK39qLw82"]),
        ("pwd: Optional[str] = rb'zK39qLw82'", ["zK39qLw82"]),
        ("my_pwd = 'zK39qLw82'.encode('utf8')", ["zK39qLw82"]),
        ("password_" + "x" * 5000 + ' = "zK39qLw82mXp7Tt4"', ["zK39qLw82mXp7Tt4"]),
        ("db_pwd" + " " * 5000 + '= "zK39qLw82mXp7Tt4"', ["zK39qLw82mXp7Tt4"]),
        ("pwd: " + "T" * 5000 + " = 'zK39qLw82'", ["zK39qLw82"]),
        ("pwd = 'open", []),
        ("pwd = 'zK39", []),
        ("the pwd: see below\n'quoted words 12' said", []),
    ],
)
def test_lexer(text, want):
    assert [text[a:b] for a, b in secrets.literals(text)] == want


def written_out(rng, name, secret):
    """A way to write an assignment down, and the parts that the secret takes in it."""
    cut = rng.randint(1, len(secret) - 1)
    a, b, q = secret[:cut], secret[cut:], rng.choice("\"'")
    return rng.choice(
        [
            (f"{name} = {q}{secret}{q}", [secret]), (f"{name} := {q * 3}{secret}{q * 3}", [secret]), (f"const {name}: string = `{secret}`;", [secret]),
            (f"{q}{name}{q}: {q}{secret}{q},", [secret]), (f"cfg[{q}{name}{q}] = {q}{a}{q} + {q}{b}{q}", [a, b]), (f"{name} => \n  {q}{secret}{q}", [secret]),
            (f"{name} = ({q}{a}{q}\n   {q}{b}{q})", [a, b]), (f"  {name}: |\n     {secret}", [secret]), (f"VARQ = {q}{secret}{q}\n{name} = VARQ", [secret]),
            (f"{name} = VARQ\nVARQ = {q}{secret}{q}", [secret]), (f"{name} = \\\n {q}{secret}{q}", [secret]), (f"<{name}>{secret}</{name}>", [secret]), (f"export {name}={secret}", [secret]),
        ]
    )


@pytest.mark.parametrize("seed", range(60))
def test_all_written_secrets_and_nothing_else(seed):
    rng = random.Random(seed)
    text, want = "", []
    for k in range(rng.randint(1, 8)):
        text += rng.choice(["A line of prose: with signs = and more.\n", "width = 12\nlabel: 'blue 12'\n", "if (a == b) { c: 'x1y2z3w4' }\n", ""])
        secret = "".join(rng.choice("abcdefgXYZ0123456789") for _ in range(20)) + "g1Zk7"
        plain = rng.random() < 0.3
        line, parts = written_out(rng, rng.choice(["colour", "left_margin", "title"] if plain else ["db_pwd", "DbPassphrase", "my_credentials"]) + ("" if plain else str(k)), secret)
        line = line.replace("VARQ", f"V{k}")
        at = len(text)
        for part in parts:
            at = text.__len__() + line.index(part, max(0, at - len(text)))
            if not plain:
                want.append((at, at + len(part)))
            at += len(part)
        text += line + "\n\n"
    assert secrets.literals(text) == sorted(want)


def test_time_is_linear():
    for unit in ("a", "a ", "a: ", "a = '", 'a="""', "{", "a: |\n", "x = (", "pwd = b + ", "\\\n", "<a>b", ":", "=", "'", "a\t"):
        began = time.perf_counter()
        secrets.literals(unit * 20_000)
        assert time.perf_counter() - began < 3, unit


def test_constants_that_double_are_not_written_out():
    """A chain of constants, each twice in the next, stands for more characters than any memory holds."""
    for lines in (60, 5000):
        text = "x0 = 'k9Zq2' + 'Lm4'\n" + "".join(f"x{k} = 'a1' + x{k - 1} + 'b2' + x{k - 1}\n" for k in range(1, lines)) + f"db_pwd = x{lines - 1}\n"
        began = time.perf_counter()
        found = secrets.literals(text)
        assert time.perf_counter() - began < (1 if lines == 60 else 5)
        assert len(found) == 2 * lines  # every literal that the password is made of
    text = "A = 'zK39qLw8'\nB = A + A\ndb_pwd = B + 'x'"
    assert [text[a:b] for a, b in secrets.literals(text)] == ["zK39qLw8", "x"]


def test_many_secrets_in_one_text():
    began = time.perf_counter()
    found = secrets.spans("".join(f"password = 'abcdef{k}'\n" for k in range(100_000)))
    assert len(found) == 100_000 and time.perf_counter() - began < 20


def test_joined_summaries_equal_those_of_the_whole():
    rng = random.Random(9)
    for _ in range(500):
        parts = ["".join(rng.choice("yYoOuUrR placehold9 \u00c9") for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 5))]
        if rng.random() < 0.3:
            parts = [p for x in parts for p in (x, "exa", "mple")]
        joined = secrets.Summary()
        for p in parts:
            joined.add(secrets.Summary(p, True))
        assert joined.score() == pytest.approx(secrets.literal_score("".join(parts), True)), parts


@pytest.mark.parametrize("text", ["", "PASSWORD = abc", "token==abcdefg secret:\"abcdef\" api_key='x.y/z-1' apikey : 123456", "AKIA" + "A" * 15 + " AKIA" + "B" * 16, "f" * 23 + " " + "0" * 24 + "g" + "a" * 30, "é tokeN:abcdef \U0001f600 passwd=abcdef", "toKen=abcdef", "password: token: abcdefgh"])
def test_base(text):
    found = [(secrets.KINDS[k], a, b) for k, a, b, _ in secrets.spans(text) if k < 3]
    assert found == base(text)


def test_redact():
    text = "x password=abcdef123456789012345678901234 y db_pwd = 'hunter22x'"
    assert secrets.redact(text, secrets.spans(text)) == "x password=[SECRET] y db_pwd = '[SECRET]'"
    assert secrets.redact("abc", []) == "abc"


def test_query(spark):
    sf = "/root/testdata/sf0.01"  # the smallest table that holds secrets
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op7_secrets"](spark, sf).collect()
    assert len(rows) == len(texts) and any(r.n_access or r.n_assign or r.n_hex for r in rows)
    for r in rows:
        want = base(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, _, _ in want) for kind in secrets.KINDS[:3])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("literal")] == [s for s in joined.split(",") if s]


def test_frame_edges(spark):
    rows = [(1, "token=abcdef", "s"), (1, "token=abcdef", "s"), (None, None, None), (2, "", "t"), (3, "word " * 40_000 + "token=abcdef", "u")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, secrets string")
    out = secrets.digests(secrets.scan(frame)).collect()
    assert [r.n_assign for r in out] == [1, 1, 0, 0, 1] and out[4].spans == "assign:200000:200012"
    clean = secrets.scan(frame, redacted=True).collect()
    assert clean[0].text == "token=[SECRET]" and clean[2].text is None
    assert secrets.scan(frame.limit(0)).count() == 0
