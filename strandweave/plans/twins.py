"""SQL of the composite jobs for DuckDB, with the stand-in models: texts, prompts, predictions, scores, and the jobs' loops unrolled.

The stand-in answers by MD5 digests and counts of characters (``models.StubClient``,
``models.StubEmbedder``), which SQL can say too; so whole jobs can be compared row by row.
"""

from __future__ import annotations

from ..functions import constants as C
from .models import StubClient, StubEmbedder
from .pipelines import METHODS, VARIANTS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^\\s+', ''), '\\s+$', '')"


def text(c: str) -> str:
    return f"coalesce({c}, '')"


def cut(c: str, n: int = C.TEXT_LONG) -> str:
    return f"substring({c}, 1, {n})"


def first_of(*cs: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({c}, '')" for c in cs) + ", '')"


def fill(template: str, **values: str) -> str:
    """``template`` with SQL in the place of its fields."""
    out, rest = [], template
    while rest:
        at, name = min(((rest.find("{%s}" % n), n) for n in values if "{%s}" % n in rest), default=(-1, ""))
        if at < 0:
            out.append(lit(rest))
            break
        out += [lit(rest[:at]), f"({values[name]})"]
        rest = rest[at + len(name) + 2 :]
    return "(" + " || ".join(out) + ")"


def truncated(c: str, budget: int) -> str:
    """Head and tail of a text beyond ``budget``; all budgets used here leave room for both."""
    head = max(500, (budget - 120) * 2 // 3)
    tail = budget - head - 120
    return f"(CASE WHEN length({c}) <= {budget} THEN {c} ELSE substring({c}, 1, {head}) || E'\\n\\n... [' || (length({c}) - {head} - {tail}) || E' characters omitted for context limit] ...\\n\\n' || right({c}, {tail}) END)"


def action_line(a: str = "", stamped: bool = True) -> str:
    kind, target, body = text(f"{a}action_type"), cut(text(f"{a}target")), cut(text(f"{a}action_text"))
    lead = f"'[' || {text(f'{a}timestamp')} || '] ' || " if stamped else ""
    return f"""({lead}CASE WHEN {kind} = 'reply' AND {target} <> '' THEN 'Reply to original: "' || {target} || '" | reply text: "' || {body} || '"'
        WHEN {kind} = 'reply' THEN 'User commented (context unknown): "' || {body} || '"' WHEN {kind} = 'post' THEN 'User posted: "' || {body} || '"'
        WHEN {kind} = 'like' THEN 'User liked: "' || {target} || '..."' WHEN {kind} = 'repost' THEN 'User reposted: "' || {target} || '..."'
        ELSE 'User performed ' || {kind} || ' on: "' || {target} || '..."' END)"""


def decision_scenario(a: str = "") -> str:
    kind, target, body = text(f"{a}action_type"), strip(text(f"{a}target")), strip(text(f"{a}action_text"))
    ask = lit('"\nWhich type of user behavior is this most likely generated from?')
    reply = lit('"\n(The reply text the user will publish is predicted separately; use the quoted text as the object of the reply.)\nWhich type of user behavior is this most likely: reply, or a different action?')
    lead = lit('The user is about to send a **reply**. The **original post or comment they are replying to** is:\n"')
    return f"""(CASE WHEN {kind} = 'post' THEN {lit('Draft/surface text associated with the next action (e.g. post body):' + chr(10) + '"')} || {cut(first_of(body, target))} || {ask}
        WHEN {kind} = 'reply' THEN {lead} || {cut(f"coalesce(nullif({target}, ''), nullif({body}, ''), '(unknown)')")} || {reply}
        ELSE {lit('Context of the next action (e.g. target post text):' + chr(10) + '"')} || {cut(first_of(target, body))} || {ask} END)"""


def content_scenario(a: str = "") -> str:
    kind, target = text(f"{a}action_type"), strip(text(f"{a}target"))
    lead = lit('Output **only** the text of the user\'s reply (no meta-commentary).\nOriginal post/comment the user is replying to (must respond to this):\n"')
    missing = lit("(original post to reply to is missing in data — infer briefly)")
    return f"""(CASE WHEN {kind} = 'post' THEN 'Write a post, what content?'
        WHEN {kind} = 'reply' THEN {lead} || coalesce(nullif({cut(target)}, ''), {missing}) || {lit('"' + chr(10) + 'What is the reply text?')} ELSE 'What content to generate?' END)"""


def decision_prompt(profile: str, block: str, a: str = "") -> str:
    return fill(C.DECISION_INPUT, user_profile=profile, action_history=block, scenario=decision_scenario(a), available_actions=lit(C.AVAILABLE_ACTIONS))


def content_prompt(profile: str, block: str, a: str = "") -> str:
    return fill(C.CONTENT_INPUT, user_profile=profile, action_history=block, scenario=content_scenario(a))


def persona_prompt(n: str, history: str) -> str:
    return fill(C.FREE_FORM, action_count=f"CAST({n} AS VARCHAR)", behavior_data=truncated(history, C.BEHAVIOR_CHARS))


def refinement_prompt(old: str, block: str) -> str:
    return fill(C.REFINEMENT, old_persona=truncated(old, C.PROFILE_CHARS), behavior_discrepancies=truncated(block, C.PROFILE_CHARS))


def refine_block(history: str, w: int) -> str:
    return f"({lit('(Incremental persona update: no predicted-vs-actual errors.)' + chr(10) + 'Align the persona with these **actual behaviors in ')} || {lit(f'W{w}')} || {lit('**:' + chr(10) * 2)} || {history})"


def digest(model: str, system: str, prompt: str, seed: str = "'0'") -> str:
    return f"md5({model} || '|' || {seed} || '|' || {system} || '|' || {prompt})"


def answer(h: str) -> str:
    return f"(substr({h}, 1, 9) || ' ' || substr({h}, 10, 9))"


def failed(h: str, failing: int) -> str:
    hexadecimal = lambda i: f"(instr('0123456789abcdef', substr({h}, {i}, 1)) - 1)"
    return f"({hexadecimal(31)} * 16 + {hexadecimal(32)} < {failing})" if failing else "false"


def similarity(a: str, b: str) -> str:
    n = lambda t, c: f"(length({t}) - length(replace({t}, '{c}', '')) + 1)"
    chars = StubEmbedder().counted
    dot, aa, bb = (" + ".join(f"{n(x, c)} * {n(y, c)}" for c in chars) for x, y in ((a, b), (a, a), (b, b)))
    return f"(CASE WHEN coalesce({a}, '') <> '' AND {b} <> '' THEN ({dot}) / (sqrt({aa}) * sqrt({bb})) END)"


# the label that each answer of the stand-in is read as: "repost" holds "post"
_READ = [("post" if x == "repost" else x) for x in StubClient().labels]
ACTUAL = f"(CASE WHEN coalesce(action_type, '') = 'reply' THEN coalesce(action_text, '') ELSE {first_of('action_text', 'target')} END)"


def windows(number: int) -> str:
    """CTEs ``w`` (windowed actions), ``win`` (texts of each window) and ``hist`` (history block, and the block of the window before)."""
    size = C.WINDOW_SIZE
    last = f"string_agg({action_line(stamped=False)}, E'\\n' ORDER BY wpos) FILTER (wpos >= {size - C.HISTORY})"
    return f"""w AS MATERIALIZED (SELECT *, CAST(rn // {size} AS INTEGER) AS window_idx, CAST(rn % {size} AS INTEGER) AS wpos FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ingest_seq) - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM actions) WHERE n >= {size * number} AND rn < {size * number}),
    win AS MATERIALIZED (SELECT user_id, window_idx, string_agg({action_line()}, E'\\n' ORDER BY wpos) AS shown, {last} AS tail FROM w GROUP BY ALL),
    hist AS MATERIALIZED (SELECT n.user_id, n.window_idx, coalesce({truncated('p.tail', C.HISTORY_CHARS)}, {lit(C.NO_HISTORY)}) AS block,
        {truncated("('### Recent behaviors (observed window W' || p.window_idx || E')\\n' || p.shown)", C.HISTORY_CHARS)} AS observed
        FROM win n LEFT JOIN win p ON p.user_id = n.user_id AND p.window_idx = n.window_idx - 1),
    users AS (SELECT user_id, min(community_id) AS community_id FROM w GROUP BY user_id)"""


def predicted(name: str, src: str, failing: int = 0) -> str:
    """CTE of predictions of ``src`` (user_id, key, w, am, profile, block), one row an action."""
    labels = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_READ))
    code = f"(ascii(substr(h1, 1, 1)) * 31 + ascii(substr(h1, 2, 1))) % {len(_READ)}"
    h1 = digest("s.am", lit(C.DECISION_INSTRUCTION), decision_prompt("s.profile", "s.block", "a."))
    h2 = digest("s.am", lit(C.CONTENT_INSTRUCTION), content_prompt("s.profile", "s.block", "a."))
    return f"""{name} AS MATERIALIZED (SELECT *, {similarity('said', 'actual')} AS sim FROM (
        SELECT user_id, key, w, wpos, action_type, action_text, target, CASE {code} {labels} END AS pred, {answer('h2')} AS said, {ACTUAL} AS actual, {failed('h1', failing)} OR coalesce({failed('h2', failing)}, false) AS bad FROM (
            SELECT s.user_id, s.key, s.w, a.wpos, a.action_type, a.action_text, a.target, {h1} AS h1, CASE WHEN coalesce(a.action_type, '') IN ('post', 'reply') THEN {h2} END AS h2
            FROM {src} s JOIN w a ON a.user_id = s.user_id AND a.window_idx = s.w)))"""


def label(c: str) -> str:
    low = f"regexp_replace(lower({strip(text(c))}), '^re-post$', 'repost')"
    return f"(CASE WHEN {low} IN ('post', 'reply', 'repost', 'like') THEN {low} ELSE 'not interested' END)"


def f1(pred: str = "p", actual: str = "a", ok: str = "ok") -> str:
    count = lambda c: f"count(*) FILTER ({ok} AND {c})"
    return "(" + " + ".join(
        f"{wt} * coalesce(2.0 * {count(f"{pred} = '{c}' AND {actual} = '{c}'")} / nullif(2.0 * {count(f"{pred} = '{c}' AND {actual} = '{c}'")} + {count(f"{pred} = '{c}' AND {actual} <> '{c}'")} + {count(f"{pred} <> '{c}' AND {actual} = '{c}'")}, 0), 0)"
        for c, wt in C.ACTION_WEIGHTS.items()
    ) + ")"


def scored(name: str, pred: str) -> str:
    """CTE (user_id, key, w, f, l, q, bad) of predictions."""
    return f"""{name} AS MATERIALIZED (SELECT *, {C.ALPHA} * f + (1 - {C.ALPHA}) * l AS q FROM (SELECT user_id, key, w, {f1()} AS f,
        coalesce(avg(sim) FILTER (a IN ('post', 'reply') AND coalesce(said, '') <> '' AND coalesce(action_text, '') <> ''), 0) AS l, bool_or(bad) AS bad
        FROM (SELECT *, p <> 'not interested' AND a <> 'not interested' AS ok FROM (SELECT *, {label('pred')} AS p, {label('action_type')} AS a FROM {pred})) GROUP BY user_id, key, w))"""


def discrepancies(name: str, pred: str, keys: str = "user_id, key") -> str:
    """CTE (keys, block) of the texts of differences of predictions (pred, said, sim, action_type, action_text, target, wpos)."""
    kind, said, body, target = "coalesce(action_type, 'unknown')", text("said"), text("action_text"), text("target")
    shown = lambda c: f"'\"' || coalesce(nullif({cut(c, 200)}, ''), '(empty)') || '\"'"
    full = f"(CASE WHEN {kind} = 'reply' THEN {body} ELSE {first_of(body, target)} END)"
    post = f"coalesce(nullif({cut(strip(target))}, ''), '(original post missing)')"
    scene = f"(CASE WHEN {kind} = 'post' THEN 'Generate post content' WHEN {kind} = 'reply' THEN 'Generate reply to: \"' || {post} || '\"' ELSE 'Generate content' END)"
    scene += f" || CASE WHEN sim IS NOT NULL AND NOT isnan(sim) AND {said} <> '' AND {full} <> '' THEN ' [Similarity: ' || printf('%.3f', round(sim, 3)) || ']' ELSE '' END"
    short = f"(CASE WHEN coalesce(action_type, '') IN ('post', 'reply', 'repost', 'like') THEN 'Predict action type for ' || action_type || ' scenario' ELSE 'Predict action type' END)"
    context = f"(CASE WHEN {kind} = 'reply' AND {target} <> '' THEN 'Reply context: \"' || {cut(target, 200)} || E'\"\\n' WHEN {kind} IN ('post', 'like', 'repost') AND {first_of(target, body)} <> '' THEN 'Content: \"' || {cut(first_of(target, body), 150)} || E'\"\\n' ELSE '' END)"
    pred_ = "coalesce(pred, 'unknown')"
    lines = f"[{strip('x')} FOR x IN string_split(scene, E'\\n') IF {strip('x')} <> '']"
    core = f"array_to_string(CASE WHEN starts_with(ls[1], '[') AND ends_with(ls[1], ']') THEN ls[2:] ELSE ls END, E'\\n')"
    return f"""{name} AS MATERIALIZED (
        WITH b AS (SELECT {keys}, wpos, 0 AS part, '[TEXT_GENERATION] ' || {scene} AS scene, '' AS obj, {shown(said)} AS pr, {shown(full)} AS ac FROM {pred} WHERE {kind} IN ('post', 'reply')
            UNION ALL SELECT {keys}, wpos, 1, '[DECISION_ONLY] ' || {short}, {context}, {pred_}, {kind} FROM {pred} WHERE {pred_} <> {kind}),
        c AS (SELECT *, {core} AS core FROM (SELECT *, {lines} AS ls FROM b)),
        d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY {keys}, core, {strip('obj')}, {strip('pr')}, {strip('ac')} ORDER BY wpos, part) = 1),
        e AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY wpos, part) AS i FROM d),
        f AS (SELECT {keys}, string_agg('Scenario [' || i || ']: ' || scene || E'\\n' || obj || 'Predicted action: ' || pr || E'\\nActual action: ' || ac || E'\\n', E'\\n' ORDER BY i) AS t FROM e GROUP BY ALL)
        SELECT k.*, coalesce(f.t, {lit(C.NO_DISCREPANCY)}) AS block FROM (SELECT DISTINCT {keys} FROM {pred}) k LEFT JOIN f ON {' AND '.join(f'k.{x.strip()} IS NOT DISTINCT FROM f.{x.strip()}' for x in keys.split(','))})"""


def chain(steps: int, failing: int = 0, number: int = C.NUM_WINDOWS_CHAIN) -> str:
    """CTEs of the chain evaluation of all methods: ``every`` (rows) and ``saved`` (personas), and the state ``s{k}`` before each step."""
    setting = ", ".join(f"('{m.name}', '{m.update}', 'persona-{m.persona_model}', 'action-{m.action_model}', {m.history}, {m.persona}, '{m.accept}')" for m in METHODS)
    h0 = digest("pm", lit(C.SYSTEM_PROFILE), persona_prompt(str(C.WINDOW_SIZE), "shown"))
    ctes = [
        windows(number), f"m(key, upd, pm, am, seen, has, accept) AS (VALUES {setting})",
        f"s0 AS MATERIALIZED (SELECT user_id, key, upd, pm, am, seen, has, accept, CASE WHEN has THEN {answer('h')} ELSE '' END AS profile, has AND {failed('h', failing)} AS bad FROM (SELECT win.user_id, m.*, {h0} AS h FROM win, m WHERE win.window_idx = 0))",
    ]
    rows, saved = [], ["SELECT user_id, key AS method, 0 AS step_index, profile FROM s0 WHERE has AND NOT bad"]

    def source(name: str, state: str, w: int, where: str = "true") -> str:
        block = f"CASE WHEN s.seen THEN h.block ELSE {lit(C.NO_HISTORY)} END"
        return f"{name} AS MATERIALIZED (SELECT s.user_id, s.key, {w} AS w, s.am, s.profile, {block} AS block FROM {state} s JOIN hist h ON h.user_id = s.user_id AND h.window_idx = {w} WHERE {where})"

    for k in range(steps):
        w = k + 1
        ctes += [source(f"x{k}", f"s{k}", w), predicted(f"p{k}", f"x{k}", failing), scored(f"g{k}", f"p{k}"), discrepancies(f"d{k}", f"p{k}")]
        rows.append(f"SELECT s.user_id, s.key, {k} AS step_index, 'W{w}' AS target_window, g.f, g.l, g.q, s.bad OR g.bad AS bad FROM s{k} s JOIN g{k} g ON g.user_id = s.user_id AND g.key = s.key")
        upto = f"(SELECT user_id, string_agg(shown, E'\\n' ORDER BY window_idx) AS so_far, any_value(shown) FILTER (window_idx = {w}) AS shown FROM win WHERE window_idx <= {w} GROUP BY user_id)"
        prompt = f"CASE s.upd WHEN 'rebuild' THEN {persona_prompt(str(C.WINDOW_SIZE * (w + 1)), 't.so_far')} WHEN 'incremental' THEN {refinement_prompt('s.profile', refine_block('t.shown', w))} ELSE {refinement_prompt('s.profile', 'd.block')} END"
        system = f"CASE s.upd WHEN 'rebuild' THEN {lit(C.SYSTEM_PROFILE)} ELSE {lit(C.SYSTEM_REFINEMENT)} END"
        ctes += [
            f"n{k} AS MATERIALIZED (SELECT *, {answer('h')} AS profile, {failed('h', failing)} AS nbad FROM (SELECT s.* EXCLUDE (profile), {digest('s.pm', system, prompt)} AS h FROM s{k} s JOIN {upto} t ON t.user_id = s.user_id JOIN d{k} d ON d.user_id = s.user_id AND d.key = s.key WHERE s.upd <> 'none'))",
            source(f"y{k}", f"n{k}", w, "s.upd = 'error' AND s.accept = 'improve'"), predicted(f"a{k}", f"y{k}", failing), scored(f"b{k}", f"a{k}"),
            f"""s{w} AS MATERIALIZED (SELECT s.* EXCLUDE (profile, bad), CASE WHEN n.key IS NULL THEN s.profile WHEN b.key IS NULL OR b.q > g.q THEN n.profile ELSE s.profile END AS profile,
                s.bad OR coalesce(g.bad, false) OR coalesce(n.nbad, false) OR coalesce(b.bad, false) AS bad
                FROM s{k} s LEFT JOIN g{k} g ON g.user_id = s.user_id AND g.key = s.key LEFT JOIN n{k} n ON n.user_id = s.user_id AND n.key = s.key LEFT JOIN b{k} b ON b.user_id = s.user_id AND b.key = s.key)""",
        ]
        saved.append(f"SELECT user_id, key, {w}, profile FROM s{w} WHERE has AND NOT bad")
    return ",\n".join([*ctes, f"every AS ({' UNION ALL '.join(rows)})", f"saved AS ({' UNION ALL '.join(saved)})"])


def chain_rows(steps: int, failing: int = 0, updated_last: bool = False) -> str:
    last = f" UNION ALL SELECT user_id, key, bad FROM s{steps}" if updated_last else ""
    nothing = lambda c: f"CASE WHEN NOT b.bad THEN round({c}, 10) END AS {c}"
    return f"""WITH {chain(steps, failing)}, bad AS (SELECT user_id, key, bool_or(bad) AS bad FROM (SELECT user_id, key, bad FROM every UNION ALL SELECT user_id, key, bad FROM s{steps - 1}{last}) GROUP BY ALL)
        SELECT e.user_id, u.community_id, e.key AS method, e.step_index, e.target_window, {nothing('f')}, {nothing('l')}, {nothing('q')}, CASE WHEN b.bad THEN 'CallError: stand-in failure' END AS error
        FROM every e JOIN bad b ON b.user_id = e.user_id AND b.key = e.key JOIN users u ON u.user_id = e.user_id"""


def chain_personas(steps: int) -> str:
    return f"WITH {chain(steps)} SELECT * FROM saved WHERE step_index < {steps}"


def chain_three(steps: int) -> str:
    """The last persona before and after its update in the last three windows."""
    parts, ctes = [], []
    for who, state in (("old", f"s{steps - 1}"), ("new", f"s{steps}")):
        for place, w in (("past", steps - 2), ("current", steps - 1), ("future", steps)):
            n = f"{who}_{place}"
            ctes += [f"x_{n} AS MATERIALIZED (SELECT s.user_id, s.key, {w} AS w, s.am, s.profile, CASE WHEN s.seen THEN h.block ELSE {lit(C.NO_HISTORY)} END AS block FROM {state} s JOIN hist h ON h.user_id = s.user_id AND h.window_idx = {w} WHERE s.upd <> 'none')", predicted(f"p_{n}", f"x_{n}"), scored(f"g_{n}", f"p_{n}")]
            parts.append(f"SELECT user_id, key AS method, '{who}' AS persona, '{place}' AS place, 'W{w}' AS target_window, round(f, 10) AS f, round(l, 10) AS l, round(q, 10) AS q FROM g_{n}")
    return f"WITH {chain(steps)}, {', '.join(ctes)} {' UNION ALL '.join(parts)}"


def slice_rows(mode: str, failing: int = 0) -> str:
    """The slice evaluation of all variants in one mode; the rows of users with enough windows."""
    setting = ", ".join(f"('{n}', '{d}', '{m}', '{'commercial' if m == 'commercial' else f'persona-{m}'}')" for n, d, m in VARIANTS)
    h0 = digest("v.pm", lit(C.SYSTEM_PROFILE), persona_prompt(str(C.WINDOW_SIZE), "win.shown"))
    ctes = [
        windows(C.NUM_WINDOWS), f"v(key, drive, maker, pm) AS (VALUES {setting})",
        f"s0 AS MATERIALIZED (SELECT *, {answer('h')} AS profile, {failed('h', failing)} AS bad FROM (SELECT win.user_id, v.*, {h0} AS h FROM win, v WHERE win.window_idx = 0))",
    ]

    def run(name: str, state: str, w: int) -> None:
        profile = strip("s.profile || E'\\n\\n' || coalesce(h.observed, '')") if w else "s.profile"
        ctes.extend([
            f"x_{name} AS MATERIALIZED (SELECT s.user_id, s.key, {w} AS w, 'action-tuned' AS am, {profile} AS profile, {'h.block' if w else lit(C.NO_HISTORY)} AS block FROM {state} s JOIN hist h ON h.user_id = s.user_id AND h.window_idx = {w})",
            predicted(f"p_{name}", f"x_{name}", failing), scored(f"g_{name}", f"p_{name}"),
        ])

    def refine(new: str, state: str, pred: str, w: int) -> None:
        upto = f"(SELECT user_id, string_agg(shown, E'\\n' ORDER BY window_idx) AS so_far, any_value(shown) FILTER (window_idx = {w}) AS shown FROM win WHERE window_idx <= {w} GROUP BY user_id)"
        prompt = f"CASE s.drive WHEN 'regeneration' THEN {persona_prompt(str(C.WINDOW_SIZE * (w + 1)), 't.so_far')} WHEN 'incremental' THEN {refinement_prompt('s.profile', refine_block('t.shown', w))} ELSE {refinement_prompt('s.profile', 'd.block')} END"
        system = f"CASE s.drive WHEN 'regeneration' THEN {lit(C.SYSTEM_PROFILE)} ELSE {lit(C.SYSTEM_REFINEMENT)} END"
        ctes.extend([
            discrepancies(f"d_{new}", f"p_{pred}"),
            f"{new} AS MATERIALIZED (SELECT * EXCLUDE (h, bad0), {answer('h')} AS profile, bad0 OR {failed('h', failing)} AS bad FROM (SELECT s.user_id, s.key, s.drive, s.maker, s.pm, s.bad AS bad0, {digest('s.pm', system, prompt)} AS h FROM {state} s JOIN {upto} t ON t.user_id = s.user_id JOIN d_{new} d ON d.user_id = s.user_id AND d.key = s.key))",
        ])

    states, cols = ["s0", "s1"], {}
    if mode == "w0_w1_w2_p0p1":
        for i in range(3):
            run(f"a{i}", "s0", i)
        refine("s1", "s0", "a1", 1)
        for i in range(3):
            run(f"b{i}", "s1", i)
        scores = [*(f"a{i}" for i in range(3)), *(f"b{i}" for i in range(3))]
        for lead, side, col in (("P0", "a", "W1"), ("P1", "b", "W2")):
            for c in "flq":
                cols |= {f"{lead}_W{i}_{c.upper()}": f"g_{side}{i}.{c}" for i in range(3)}
                cols[f"{col}_{c.upper()}"] = f"(g_{side}0.{c} + g_{side}1.{c} + g_{side}2.{c}) / 3"
    else:
        run("a", "s0", 1)
        refine("s1", "s0", "a", 1)
        run("b", "s1", 2)
        scores, first, second = ["a", "b"], "a", "b"
        if mode == "w2_w3":
            refine("s2", "s1", "b", 2)
            run("c", "s2", 3)
            scores, first, second = ["a", "b", "c"], "b", "c"
            states.append("s2")
        for c in "flq":
            cols |= {f"W1_{c.upper()}": f"g_{first}.{c}", f"W2_{c.upper()}": f"g_{second}.{c}"}
    bad = " OR ".join([*(f"{s}.bad" for s in states), *(f"g_{g}.bad" for g in scores)])
    joins = " ".join(f"JOIN {t} ON {t}.user_id = s0.user_id AND {t}.key = s0.key" for t in [*states[1:], *(f"g_{g}" for g in scores)])
    shown = ", ".join(f"CASE WHEN NOT ({bad}) THEN round({e}, 10) END AS {c}" for c, e in cols.items())
    return f"WITH {', '.join(ctes)} SELECT s0.user_id, s0.key AS profile_variant, s0.maker AS persona_backend, {shown}, CASE WHEN {bad} THEN 'CallError: stand-in failure' END AS error, '{mode}' AS slice_eval_mode FROM s0 {joins}"


def pair_rounds(rounds: int = C.ROUNDS, n: int = C.CANDIDATES) -> str:
    """CTEs of pair mining: ``found`` and ``log``."""
    commercial = round(n * C.COMMERCIAL_RATIO)
    h0 = digest("'persona'", lit(C.SYSTEM_PROFILE), persona_prompt(str(C.WINDOW_SIZE), "shown"))
    source = lambda c: f"CASE WHEN {c} >= {n - commercial} THEN 'commercial' ELSE 'base' END"
    ctes = [windows(C.NUM_WINDOWS), f"s0 AS MATERIALIZED (SELECT user_id, {answer(h0)} AS profile, 'base' AS source FROM win WHERE window_idx = 0)"]
    found, log = [], []
    at = lambda who, w: f"SELECT s.user_id, s.key, {w} AS w, 'action' AS am, s.profile, {{block}} AS block FROM {who} s JOIN hist h ON h.user_id = s.user_id AND h.window_idx = {w}"
    for r in range(rounds):
        trip = lambda who, r=r: " UNION ALL ".join(at(who, r + i).format(block=lit(C.NO_HISTORY) if i == 0 else "h.block") for i in range(3))
        prompt = refinement_prompt("s.profile", "d.block")
        ctes += [
            f"base{r} AS (SELECT user_id, -1 AS key, profile FROM s{r})", f"bx{r} AS MATERIALIZED ({trip(f'base{r}')})", predicted(f"bp{r}", f"bx{r}"), scored(f"bg{r}", f"bp{r}"),
            discrepancies(f"d{r}", f"(SELECT * FROM bp{r} WHERE w = {r + 1})"),
            f"cand{r} AS MATERIALIZED (SELECT s.user_id, c.key, {answer(digest(f"CASE WHEN c.key >= {n - commercial} THEN 'commercial' ELSE 'persona' END", lit(C.SYSTEM_REFINEMENT), prompt, 'CAST(c.key AS VARCHAR)'))} AS profile FROM s{r} s JOIN d{r} d ON d.user_id = s.user_id, range({n}) c(key))",
            f"cx{r} AS MATERIALIZED ({trip(f'cand{r}')})", predicted(f"cp{r}", f"cx{r}"), scored(f"cg{r}", f"cp{r}"),
            f"gate{r} AS (SELECT c.user_id, max(c.q) > max(b.q) AS improved FROM cg{r} c JOIN bg{r} b ON b.user_id = c.user_id AND b.w = c.w WHERE c.w = {r + 1} GROUP BY c.user_id)",
            f"""rew{r} AS MATERIALIZED (SELECT user_id, key, r_pre, r_cur, r_fut, r_pre + r_cur + r_fut AS r_all FROM (SELECT c.user_id, c.key, {', '.join(f"max(c.q - b.q) FILTER (c.w = {r + i}) AS {x}" for i, x in enumerate(('r_pre', 'r_cur', 'r_fut')))}
                FROM cg{r} c JOIN bg{r} b ON b.user_id = c.user_id AND b.w = c.w JOIN gate{r} g ON g.user_id = c.user_id AND g.improved GROUP BY ALL))""",
            f"best{r} AS MATERIALIZED (SELECT * FROM rew{r} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY r_all DESC, key) = 1)",
            f"""pair{r} AS MATERIALIZED (SELECT h.user_id, {r + 1} AS round_idx, h.key AS chosen, l.key AS rejected, h.r_all - l.r_all AS margin,
                CASE WHEN h.r_all > {C.TAU_PLUS} AND l.r_all < {C.TAU_MINUS} AND h.r_all - l.r_all > {C.DELTA} THEN 'tau_delta' ELSE 'abs_delta' END AS pair_rule, {source('h.key')} AS chosen_source, {source('l.key')} AS rejected_source,
                s.source AS baseline_source, hp.profile AS chosen_profile, lp.profile AS rejected_profile, s.profile AS baseline_profile, d.block AS discrepancies, h.r_all AS chosen_r_all, l.r_all AS rejected_r_all
                FROM rew{r} h JOIN rew{r} l ON l.user_id = h.user_id AND h.r_all > 0 AND l.r_all < 0 JOIN cand{r} hp ON hp.user_id = h.user_id AND hp.key = h.key JOIN cand{r} lp ON lp.user_id = l.user_id AND lp.key = l.key
                JOIN s{r} s ON s.user_id = h.user_id JOIN d{r} d ON d.user_id = h.user_id
                WHERE (h.r_all > {C.TAU_PLUS} AND l.r_all < {C.TAU_MINUS} AND h.r_all - l.r_all > {C.DELTA}) OR h.r_all - l.r_all > {C.ABS_DELTA})""",
            f"""s{r + 1} AS MATERIALIZED (SELECT s.user_id, coalesce(c.profile, s.profile) AS profile, CASE WHEN b.key IS NULL THEN s.source ELSE {source('b.key')} END AS source FROM s{r} s
                LEFT JOIN best{r} b ON b.user_id = s.user_id LEFT JOIN cand{r} c ON c.user_id = b.user_id AND c.key = b.key {f'WHERE s.user_id IN (SELECT user_id FROM pair{r})' if r == 0 else ''})""",
        ]
        found.append(f"SELECT * FROM pair{r}")
        log.append(f"""SELECT s.user_id, {r + 1} AS round_idx, g.improved, b.key AS best_cand, round(b.r_all, 10) AS best_r_all, CAST((SELECT count(*) FROM pair{r} p WHERE p.user_id = s.user_id) AS INTEGER) AS n_pairs,
            CASE WHEN NOT g.improved THEN 'no_candidate_improves_w1_over_baseline' END AS skip_reason FROM s{r} s JOIN gate{r} g ON g.user_id = s.user_id LEFT JOIN best{r} b ON b.user_id = s.user_id""")
    return ",\n".join([*ctes, f"found AS ({' UNION ALL '.join(found)})", f"log AS ({' UNION ALL '.join(log)})"])
