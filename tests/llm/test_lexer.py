"""The lexer of assignments: forms that it knows, planted pairs among noise, and time in proportion to the text."""

import random
import time

import pytest

from corollary.llm import secrets
from corollary.llm.lexer import assignments

SECRET = "q8Zr-12kLp_0x"


def found(text):
    """What the lexer reports under sensitive names, as text."""
    return [text[s:e] for s, _, e in secrets.lexed_spans(text)]


@pytest.mark.parametrize("text", [
    'pwd = "%s"', "pwd = '%s' # note", 'pwd = """%s"""', "pwd: %s", "DB_PWD=%s", "export DB_PWD=%s\n", 'pwd = R"%s"', "spring.datasource.pwd=%s",
    'pwd = getenv("DB", "%s")', 'pwd = cfg = "%s"', 'cfg["db_pwd"] = "%s"', '{"db": {"pwd": "%s", "x": 1}}', '{\n  "db": {\n    "pwd":\n      "%s"\n  }\n}',
    'connect(user="u", pwd="%s", port=5)', 'const dbPwd: string = "%s";', 'conn.setPwd("%s")', 'DSN := `%s`', "<pwd>%s</pwd>", '<add key="dbPwd" value="%s"/>',
    "<key>pwd</key><string>%s</string>", "credentials:\n  value: %s\n", "[credentials]\nvalue = %s\n", "pwd: |\n  %s\nuser: bob\n", "it's pwd: %s, don't",
    "PWD=$(cat <<EOF\n%s\nEOF\n)\n", 'k = "%s"\nclient.secret_value = k\n', 'a = "%s"\nb = a\npwd = b', 'A="%s"\nPWD="${A}"', 'A="%s"\nPWD=$A', 'k = "%s"\npwd = f"{k}"',
])
def test_forms_of_assignment(text):
    text = text % SECRET
    assert found(text) == [SECRET]


def test_parts_of_a_literal():
    assert found('pwd := "q8Zr" + "-12kLp_0x"') == ["q8Zr", "-12kLp_0x"] == found('pwd = ("q8Zr" +\n  "-12kLp_0x")\n')
    assert found('a = "Zx81kLmN77"\npwd = f"{a}-rest9"\n') == ["Zx81kLmN77", "-rest9"]


@pytest.mark.parametrize("text", [
    "pwd = os.environ.get_password_from_vault9\n", 'if pwd == "q8Zr-12kLp_0x":', 'pwd = getenv("Q8ZR_12KLP_0X")', 'user = "q8Zr-12kLp_0x"', "pwd", "pwd =", "", 'x = "pwd"\n"q8Zr-12kLp_0x"',
    "pwd = vault::read9(path)\n", "credentials:\n  name: x\nother:\n  value: q8Zr-12kLp_0x\n", 'pwd = "changeme-1234"', "https://pwd.example/a:b", 'pwd = "your-Token-99"',
])
def test_what_is_no_secret(text):
    assert found(text) == []


def test_planted_pairs_among_noise():
    """Every planted assignment, with constants that go through up to three names, and nothing else that is sensitive."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bcdfghjklm") for _ in range(rng.randint(3, 8)))
    forms = ('{} = "{}"', "{}: '{}'", 'let {} = "{}";', '{} := "{}"', "x.{} = '{}'")
    noise = ('print("{} {}")', "for {} in {}:", "{}({}, 5)", "# {} {}", "{} {} it's so, isn't it", 'if {} == "{}":', "<b>{}</b> {}", "{}[0] = {}")
    for _ in range(200):
        lines, want, names = [], [], []
        for k in range(rng.randint(1, 12)):
            kind = rng.random()
            if kind < 0.4:
                lines.append(rng.choice(noise).format(word(), word()))
            else:
                literal = "".join(rng.choice("abcDEF0123456789-_") for _ in range(14)) + "aZ9-"
                holder = f"{word()}{k}" if kind < 0.8 else f"db_pwd{k}"
                lines.append(rng.choice(forms).format(holder, literal))
                if kind < 0.8:
                    for hop in range(rng.randint(0, 2)):
                        lines.append(f"{holder}h{hop} = {holder}")
                        holder = f"{holder}h{hop}"
                    names.append((holder, literal))
                else:
                    want.append(literal)
        for k, (holder, literal) in enumerate(names):
            if rng.random() < 0.5:
                lines.append(f"secret_{k} = {holder}")
                want.append(literal)
        assert sorted(found("\n".join(lines))) == sorted(want), lines


HOSTILE = {
    "letters": "a", "dotted": "a.b_", "chain": "a=", "quotes": '"\\', "apostrophes": "'\\'", "colons": "pwd: ", "open braces": '{"value":', "open tags": "<a b", "lines": "pwd = x1\n",
    "triple": '"""\\', "blanks": "pwd" + " " * 500, "calls": "f(", "brackets": "[[[\n", "prose": "the fox jumps: over it. ", "sections": "\n[a]", "marks": "<<EOF ", "base64": 'pwd = "' + "QUJDRA09+/" * 5000 + '" ',
}


@pytest.mark.parametrize("name", HOSTILE)
def test_time_grows_with_the_length_only(name):
    took = []
    for n in (100_000, 800_000):
        text = (HOSTILE[name] * (n // len(HOSTILE[name]) + 1))[:n]
        began = time.process_time()
        secrets.lexed_spans(text)
        secrets.base_spans(text)
        took.append(time.process_time() - began)
    assert took[1] < 0.5 + 20 * took[0] and took[1] < 6


def test_very_long_runs_take_seconds():
    for unit in ("a", "QUJDRA09+/", "a.b_"):
        text = 'x = "' + unit * (10_000_000 // len(unit))
        began = time.process_time()
        assert assignments(text) and not secrets.lexed_spans(text)
        assert time.process_time() - began < 10
