import hashlib
import random
import re
from collections import defaultdict

import pytest

from larkspar.llm.op12_personal import personal_spans

SCHEMA = "doc_id long, text string"
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WS = r"\x20\x09-\x0D"


def luhn(number):
    total = 0
    for i, d in enumerate(map(int, reversed(number))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base(text):
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(BASE[kind], text):
            n = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(n) <= 19 and luhn(n), "phone": 9 <= len(n) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def cores(text):
    """Runs of marked words and brackets, word by word: (start, end, core, patterns)."""
    words = [(m.start(), m.end()) for m in re.finditer(f"[^{WS}]+", text)]
    marked = [bool(re.search("[0-9@]", text[a:b])) for a, b in words]
    i = 0
    while i < len(words):
        if not marked[i]:
            i += 1
            continue
        j = i
        while j + 1 < len(words) and re.fullmatch(" +", text[words[j][1] : words[j + 1][0]]) and (marked[j + 1] or re.fullmatch(r"[().-]+", text[words[j + 1][0] : words[j + 1][1]])):
            j += 1
        a, b = words[i][0], words[j][1]
        m = re.search(r"[A-Za-z0-9+(@][\s\S]*[A-Za-z0-9]|[A-Za-z0-9]", text[a:b])
        before_run = max((words[k][1] for k in range(i) if marked[k] or k < i and in_run(words, marked, text, k)), default=0)
        near = [k for k in range(max(0, i - 2), i) if words[k][0] >= before_run]
        norm = lambda w: re.sub("[0-9]", "0", w[:24]).lower()
        word = lambda k: text[words[k][0] : words[k][1]]
        one = word(i - 1) if i - 1 in near else ""
        two = text[words[i - 2][0] : words[i - 1][1]] if len(near) == 2 else ""
        behind = word(j + 1) if j + 1 < len(words) and not marked[j + 1] else ""
        patterns = {p for p in (one and "l " + norm(one), two and "ll " + norm(two), behind and "r " + norm(behind), one and behind and f"lr {norm(one)} {norm(behind)}") if p}
        if m:
            yield a + m.start(), a + m.end(), m[0], patterns
        i = j + 1


def in_run(words, marked, text, k):
    """Whether the word k, of brackets, belongs to a run before it."""
    while k > 0 and re.fullmatch(r"[().-]+", text[words[k][0] : words[k][1]]) and re.fullmatch(" +", text[words[k - 1][1] : words[k][0]]):
        k -= 1
        if marked[k]:
            return True
    return False


def forms(core):
    n = len(re.sub("[^0-9]", "", core))
    out = []
    if re.fullmatch(f"[^{WS}]+@[^{WS}]+", core):
        out.append(0)
    if re.fullmatch(r"[0-9a-fA-F]*([.:][0-9a-fA-F]*){2,7}", core):
        out.append(1)
    if re.fullmatch(r"[0-9]([ -]*[0-9])*", core) and 12 <= n <= 19:
        out.append(2)
    if re.fullmatch(r"[+(]?[0-9][ ().0-9/-]*", core) and 7 <= n <= 15:
        out.append(3)
    return out


def by_hand(rows, rounds=4, support=3, trust=0.8, fading=0.95):
    texts = [t or "" for _, t in rows]
    bases, all_cores, edges, known, kind = [base(t) for t in texts], [list(cores(t)) for t in texts], defaultdict(set), defaultdict(bool), {}
    for spans, found in zip(bases, all_cores, strict=True):
        for a, b, core, patterns in found:
            own = [s for s in spans if s[0] < b + 99 and s[2] > a - 99 and any(a - 99 <= s[0] for _ in [0]) and overlaps_run(s, a, b, found)]
            known[core] |= bool(own)
            if own and min(own)[0] == a and min(own, key=lambda s: (s[0], s[2]))[2] == b == max(s[2] for s in own):
                k = min(own, key=lambda s: (s[0], s[2], s[1]))[1]
                kind[core] = min(k, kind.get(core, k))
            for p in patterns:
                edges[p].add(core)
    belief, trusted = {c: (k, 1.0) for c, k in kind.items()}, {}
    for r in range(rounds):
        trusted = {}
        for p, members in edges.items():
            for k in range(4):
                got = [belief[c][1] for c in members if c in belief and belief[c][0] == k]
                if len(got) >= support and (score := round(sum(got), 9) / (len(members) + 0.5)) >= trust:
                    trusted[p, k] = score
        belief = {c: (k, 1.0) for c, k in kind.items()}
        best = defaultdict(float)
        for (p, k), score in trusted.items():
            for c in edges[p]:
                if not known[c] and k in forms(c):
                    best[c, k] = max(best[c, k], score * fading ** (r + 1))
        for (c, k), b in best.items():
            if (b, -k) > (belief.get(c, (9, 0))[1], -belief.get(c, (9, 0))[0]):
                belief[c] = (k, b)
    for (d, t), spans, found in zip(rows, bases, all_cores, strict=True):
        more = []
        for a, b, core, patterns in found:
            if not any(overlaps_run(s, a, b, found) for s in spans):
                options = [(trusted[p, k], -k) for p in patterns for k in range(4) if (p, k) in trusted and k in forms(core)]
                if options:
                    more.append((a, -max(options)[1], b))
        named = lambda ss: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(ss))
        yield (d, *(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(named(spans).encode()).hexdigest(), named(spans + more), len(more))


def overlaps_run(span, a, b, found):
    """Whether the span lies in the run whose core is a:b (spans lie in runs, and runs keep apart)."""
    return min(found, key=lambda c: max(c[0] - span[0], span[0] - c[1] + 1, 0))[:2] == (a, b)


def corpus(seed, n):
    r = random.Random(seed)
    filler = ["alpha", "bé", "the", "of", "call", "now", "𝒳", "(", "-", "x1", "1999", "3.14", "a@b", "12", "+", "5-"]
    some = [
        lambda: f"{r.choice('abé')}{r.randint(0, 99)}@mail{r.randint(0, 3)}.example.com",
        lambda: ".".join(str(r.randint(0, 300)) for _ in range(r.randint(3, 6))),
        lambda: "".join(r.choice("0123456789") for _ in range(r.choice([11, 12, 16, 16, 19, 20]))),
        lambda: f"+{r.randint(1, 99)} ({r.randint(0, 999):03}) 555-{r.randint(0, 9999):04}",
        lambda: f"+1 {r.randint(0, 9)}",
        lambda: r.choice(["4111 1111 1111 1111", "4111-1111-1111-1111", "4111  1111", "a@b.c%d@e.f", "x.@y-.z..", "0255.1.2.003", "1.2.3.4.5.6.7.8"]),
    ]
    out = [None, "", " ", "1", "@", "+", "a1\t2b\n3"]
    for _ in range(n):
        out.append("".join(r.choice(some)() + r.choice(["", ".", ",", "!!"]) + r.choice([" ", "  ", "\t"]) if r.random() < 0.3 else r.choice(filler) + r.choice([" ", " ", "\n", "  "]) for _ in range(r.randint(1, 25))))
    return out


@pytest.mark.parametrize(("support", "trust"), [(3, 0.8), (1, 0.2)])
def test_matches_plain_python(spark, support, trust):
    rows = list(enumerate(corpus(1, 250)))
    rows += [(None, "call +1 (706) 555-0000 now"), (3, rows[20][1]), (3, rows[20][1])]
    got = sorted((tuple(x) for x in personal_spans(spark.createDataFrame(rows, SCHEMA), support=support, trust=trust).drop("found").collect()), key=str)
    want = sorted(by_hand(rows, support=support, trust=trust), key=str)
    assert [g[:6] for g in got] == [w[:6] for w in want]
    assert got == want
    assert trust > 0.5 or sum(g[7] for g in got) > 4


def test_contexts_find_what_the_patterns_do_not(spark):
    rows = [(i, f"text {i} my number is +1 (706) 555-{1000 + i} thanks and so on") for i in range(8)]
    rows += [(8, "so my number is 706 555 1234 thanks"), (9, "it cost 706 555 1234 in all"), (10, "write to bob@home today")]
    rows += [(20 + i, f"please write to user{i}@mail.example.com today") for i in range(9)]
    # Found by the patterns of the first round, 555 9999 is in a pattern of its own in the next.
    got = {r.doc_id: r for r in personal_spans(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[8].spans == "phone:16:28" and [tuple(f) for f in got[8].found] == [("phone", 16, 28, False)] and got[8].n_added == 1
    assert got[9].spans == "" and got[10].spans == "email:9:17" and got[0].spans == "phone:20:37" and got[0].n_phone == 1


@pytest.mark.parametrize("text", ["a" * 300_000, "1." * 100_000, "1 " * 100_000, "a@" + "b." * 100_000 + "c", "+1" + " 2" * 60_000, "(" * 200_000, "a1@" * 60_000, "9" * 200_000])
def test_long_words_and_runs_take_no_long_search(spark, text):
    got = personal_spans(spark.createDataFrame([(1, text)], SCHEMA)).first()
    assert (got.n_email, got.n_card, got.n_phone) == (int(text.startswith("a@")), 0, 0) and got.n_ip == (25_000 if text.startswith("1.") else 0)


def test_empty_table_and_names_that_clash(spark):
    assert personal_spans(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(1, "x 1.2.3.4", 5, "s", 6, "k"), (2, None, 5, "s", 6, "k")], SCHEMA + ", _k long, spans string, N_IP long, `row` string")
    got = personal_spans(docs)
    assert got.columns == ["doc_id", "_k", "row", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "found"]
    assert sorted((r.doc_id, r._k, r.row, r.n_ip, r.spans) for r in got.collect()) == [(1, 5, "k", 1, "ip:2:9"), (2, 5, "k", 0, "")]
