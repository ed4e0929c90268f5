import random

from trawl.llm import chat


def brute(events):
    """Event by event, conversation by conversation."""
    convs = {}
    ok = [e for e in set(events) if None not in (e[0], e[1], e[2]) and e[3] in chat.KINDS]
    key = lambda e: (e[1], chat.KINDS.index(e[3]), e[5] or "", e[4] is not None, e[4] or "", e[2])
    seen, roles = set(), {}
    for e in sorted(ok, key=lambda e: (e[0], key(e))):
        if (e[0], key(e)) in seen:
            continue
        seen.add((e[0], key(e)))
        conv, _, msg, kind, role, text = e
        own = convs.setdefault(conv, {})
        if role is not None:
            roles[conv, msg] = role
        if kind == "regenerate":
            for m in [m for m in own if m >= msg]:
                del own[m]
        elif kind == "edit":
            own[msg] = text or ""
        else:
            own[msg] = own.get(msg, "") + (text or "")
    return sorted((c, m, roles.get((c, m), "unknown"), t) for c, ms in convs.items() for m, t in ms.items())


def test_same_as_event_by_event(spark):
    for seed in range(4):
        rng = random.Random(seed)
        events = []
        for _ in range(700):
            events.append((
                rng.choice([1, 2, 3, 4, None]), rng.choice([*range(60), None]), rng.choice([0, 1, 2, 3, None]), rng.choice([*chat.KINDS, "delta", "delta", "delta", "ping", None]),
                rng.choice([None, "user", "assistant"]), rng.choice([None, "", "a", "b", "<|im_end|>"]),
            ))
        events += events[:100]
        df = spark.createDataFrame([(*e, "x") for e in events], "conv_id long, seq long, message_id long, kind string, role string, text string, n_events string")
        got = sorted((r.conv_id, r.message_id, r.role, r.text) for r in chat.fold(df).collect())
        assert got == brute(events), seed


def test_render(spark):
    log = [(1, 1, 0, "start", "user", "Hi"), (1, 2, 1, "start", "assistant", None), (1, 3, 1, "delta", None, "<|im_end|>"), (1, 4, 1, "delta", None, "é"), (2, 1, 0, "delta", None, "x" * 2_000_000)]
    df = spark.createDataFrame(log, "conv_id long, seq long, message_id long, kind string, role string, text string")
    got = {r.conv_id: r for r in chat.render(chat.fold(df)).collect()}
    assert got[1].rendered == "<|im_start|>user\nHi<|im_end|>\n<|im_start|>assistant\n< |im_end|>é<|im_end|>\n" and got[1].n_messages == 2
    assert len(got[2].rendered) > 2_000_000 and got[2].rendered.startswith("<|im_start|>unknown")
    assert chat.render(chat.fold(df), style=chat.PLAIN).where("conv_id = 1").first().rendered == "user: Hi\n\nassistant: <|im_end|>é\n\n"
    assert chat.render(chat.fold(df.limit(0))).count() == 0


def test_render_nulls(spark):
    rows = [(1, 0, None, "there", 9), (1, 1, "user", None, 9), (1, 2, "user", "again", 9), (1, 2, "user", "again", 9), (1, None, "user", "first", 9), (None, 0, None, None, 9)]
    df = spark.createDataFrame(rows, "conv_id long, message_id long, role string, text string, n_messages int")
    got = {r.conv_id: (r.n_messages, r.rendered) for r in chat.render(df, style=chat.PLAIN).collect()}
    assert got == {1: (5, "user: first\n\nunknown: there\n\nuser: \n\nuser: again\n\nuser: again\n\n"), None: (1, "unknown: \n\n")}
    assert chat.render(df.limit(0)).count() == 0


def test_no_python_and_one_exchange(spark, sf_dir):
    plan = chat.query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_sql(same_as_sql):
    assert same_as_sql(chat.query, chat.SQL) > 0
