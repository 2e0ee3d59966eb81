import random

from arraylens.llm.quotes import keys, link_quotes, parse, roots
from arraylens.llm.staging import Stage

ROWS = [
    (1, 0, "user", "How do I sort a list?\nIt has numbers."),
    (1, 1, "assistant", "> how do i   sort a list?\nUse sorted()."),
    (1, 2, "user", "Thanks.\n\nWhat about sets?"),
    (1, 3, "user", "On Monday, bot wrote:\n> On Sunday, me wrote:\n>> How do I sort a list?\n>> It has numbers.\n> Use sorted().\n\nThat works."),
    (2, 0, "user", "> use sorted().\nWhy this?"),
    (2, 1, "assistant", "> never written anywhere\nBecause."),
    (2, 1, "assistant", None),
    (3, 5, "user", ""),
    (3, 6, "user", ">> What about sets?\n> Thanks.\n> > nothing\nok " + "long " * 20000),
    (None, 0, "user", "> Thanks.\nloose"),
    (4, None, "user", "loose too"),
]


def test_parse():
    body, quotes = parse(ROWS[3][3])
    assert body == "That works."
    assert quotes == [(2, ["How do I sort a list?", "It has numbers."]), (1, ["Use sorted()."])]
    assert parse(None) == (None, []) and parse("a\n\n") == ("a\n\n", []) and parse("> \n>") == ("", [])


def test_links_threads_and_order(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as node", "2 as conv", "'b' as body")
    got = link_quotes(df).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault((r.conv_id, r.turn), []).append(r)

    def one(c, t):
        return by[c, t][0]

    want = {
        (1, 0): ("root", None, None, 0, 0), (1, 1): ("quote", 1, 0, 1, 1), (1, 2): ("turn", 1, 1, 0, 0), (1, 3): ("quote", 1, 1, 2, 2),
        (2, 0): ("quote", 1, 1, 1, 1), (3, 5): ("root", None, None, 0, 0), (3, 6): ("quote", 1, 2, 3, 2),
        (None, 0): ("root", None, None, 1, 0), (4, None): ("root", None, None, 0, 0),
    }
    for k, v in want.items():
        r = one(*k)
        assert (r.via, r.reply_conv, r.reply_turn, r.n_quotes, r.n_linked) == v, k
    assert one(1, 3).body == "That works." and one(2, 0).body == "Why this?"
    assert sorted((r.via, r.n_quotes) for r in by[2, 1]) == [("turn", 0), ("turn", 1)]
    threads = {}
    for r in got:
        if r.thread_conv is not None:
            threads.setdefault((r.thread_conv, r.thread_turn), []).append(r)
    assert sorted(map(len, threads.values())) == [1, 8]
    for rows in threads.values():
        rows.sort(key=lambda r: r.position)
        assert [r.position for r in rows] == list(range(len(rows)))
        seen = set()
        for r in rows:
            assert r.reply_conv is None or (r.reply_conv, r.reply_turn) in seen
            seen.add((r.conv_id, r.turn))


def test_empty(spark):
    assert link_quotes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_roots(spark):
    draw = random.Random(3)
    up = {n: n - 1 for n in range(1001, 1100)} | {n: draw.randrange(n) for n in range(1, 300) if n % 20}
    want = {}
    for n in up:
        at = n
        while at in up:
            at = up[at]
        want[n] = at
    got = roots(spark.createDataFrame(list(up.items()), "node long, up long"), Stage(spark)).collect()
    assert len(got) == len(up) and {r.node: r.root for r in got} == want


def plain_links(rows):
    """What link_quotes returns for rows (conv, turn, role, text), by walking the messages in order."""
    messages = []
    for conv, turn, role, text in rows:
        body, quotes = parse(text)
        messages.append((conv, turn, role, body, quotes))
    messages.sort(key=lambda m: (m[0], m[1], m[2], m[3] is not None, m[3] or ""))
    first, near, out = {}, {}, []
    for n, (conv, _, _, body, _) in enumerate(messages):
        for h, _ in keys((body or "").split("\n")):
            first.setdefault(h, n)
            near.setdefault((conv, h), n)
    threads: dict = {}
    for n, (conv, turn, role, body, quotes) in enumerate(messages):
        linked, answers = 0, []
        for i, (level, lines) in enumerate(quotes):
            hits = []
            for h, size in keys(lines):
                own, other = near.get((conv, h), n), first.get(h, n)
                if own < n:
                    hits.append((1, size, -own))
                elif other < n:
                    hits.append((0, size, -other))
            if hits:
                linked += 1
                _, size, source = max(hits)
                if level == 1:
                    answers.append((size, -i, -source))
        prior = n - 1 if n and messages[n - 1][0] == conv else None
        up, via = (max(answers)[2], "quote") if answers else (prior, "turn") if prior is not None else (None, "root")
        root = n if up is None else out[up]["root"]
        at = threads[root] = threads.get(root, -1) + 1
        reply = (None, None) if up is None else messages[up][:2]
        out.append({"root": root, "row": (conv, turn, role, len(quotes), linked, via, *reply, *messages[root][:2], at)})
    return sorted(x["row"] for x in out)


def planted(n, seed):
    """Conversations whose messages quote earlier ones, whole or in part, up to three levels deep."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    rows, said = [], []
    for i in range(n):
        conv, turn = i // 7, i % 7
        own = "\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(1, 3)))
        text = own
        if said and rng.random() < 0.7:
            near = [s for s in said[-turn:]] if turn and rng.random() < 0.6 else said
            quote = rng.choice(near)
            if rng.random() < 0.4:
                quote = rng.choice(quote.split("\n"))
            lines = [("> " * rng.randint(1, 3) + x.upper() if rng.random() < 0.2 else "> " + x) for x in quote.split("\n")]
            text = "\n".join([*(["Bob wrote:"] if rng.random() < 0.3 else []), *lines, own])
        rows.append((conv, turn, rng.choice(["a", "b"]), text))
        said.append(text if rng.random() < 0.4 else own)
    return rows


def test_ten_thousand_messages_against_a_walk(spark):
    rows = planted(10_000, 11)
    got = link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    names = "conv_id turn role n_quotes n_linked via reply_conv reply_turn thread_conv thread_turn position".split()
    want = plain_links(rows)
    assert sorted(tuple(r[c] for c in names) for r in got) == want
    via = {v: sum(r[5] == v for r in want) for v in ("quote", "turn", "root")}
    assert via["quote"] > 5000 and min(via.values()) > 100


def test_a_message_of_many_lines():
    body, quotes = parse("> a\nb\n" * 100_000)
    assert len(quotes) == 100_000 and body.count("b") == 100_000
