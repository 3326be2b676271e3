"""What a host allows: settings, commands that run by themselves, tools, hand-offs, snapshots, and the score that follows.

Settings differ in shape from file to file, so they are read as variants; a value of another type than expected is taken as
absent, a text that is no JSON object gives SET-000 only. Every function is a projection or one aggregation by key."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.operators.integrity import capability, drift
from sentrel.operators.rules import findings, scan
from sentrel.sources.work import settled

# Names and patterns of agent hosts.
UNATTENDED = ["SessionStart", "SessionEnd", "PreCompact", "Notification", "Stop", "folderOpen"]
INTERPRETERS = "node npx bun deno python python3 ruby perl php sh bash zsh osascript powershell pwsh".split()
FETCHERS, RUNNERS = ["curl", "wget", "iwr"], ["sh", "bash", "node", "python", "python3"]
EGRESS = "curl wget ssh scp rsync nc ncat telnet ftp".split()
ODD_PATHS = [".github/", ".git/", "/tmp/", "~/.config/", ".cache/"]
INSTRUCTION_FILES = "AGENTS.md agents.md CLAUDE.md claude.md .cursorrules .windsurfrules .windsurf-rules GEMINI.md copilot-instructions.md".split()
INSTRUCTION_DIRS = ["skills", ".claude", ".cursor", ".github", ".windsurf"]
INBOUND = "Read WebFetch WebSearch Bash Glob Grep NotebookRead Task".split()
OUTBOUND = "Task Agent SendMessage Workflow mcp__slack__post_message mcp__github__create_issue mcp__github__create_pull_request mcp__github__add_issue_comment mcp__linear__create_issue mcp__jira__create_issue".split()
SPAWN = "Task Agent SendMessage Workflow dispatch_agent".split()


def word(*words: str) -> str:
    """A pattern of whole words, read alike by Java and RE2; texts are lower-cased first."""
    return f"(^|[^0-9a-z_])({'|'.join(words)})([^0-9a-z_]|$)"


INTERPRETER = word(*INTERPRETERS)
ANY_SHELL = "^bash$|^bash\\(\\s*\\*\\s*\\)$"
SENDS = f"^bash\\(\\s*({'|'.join(EGRESS)})([^0-9a-z_]|$)"
ALWAYS = "(^|\\n)\\s*alwaysApply:\\s*true\\s*(\\n|$)"


def _list(v: Column, path: str, kind: str = "variant") -> Column:
    return F.coalesce(F.try_variant_get(v, path, f"array<{kind}>"), F.array().cast(f"array<{kind}>"))


def _table(v: Column, path: str) -> Column:
    """(key, value) of an object."""
    return F.map_entries(F.try_variant_get(v, path, "map<string,variant>"))


def _text(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def commands(v: Column) -> Column:
    """Array of (event, command) that settings or task files run: hooks by event, and tasks that start with the folder."""
    pair = lambda event, command: F.struct(event.alias("event"), command.alias("command"))
    hooked = F.flatten(F.transform(_table(v, "$.hooks"), lambda e: F.flatten(F.transform(_list(e["value"], "$"), lambda g: F.transform(_list(g, "$.hooks"), lambda h: pair(e["key"], _text(h, "$.command")))))))
    starting = F.filter(_list(v, "$.tasks"), lambda t: F.lower(_text(t, "$.runOptions.runOn")) == "folderopen")
    tasks = F.transform(starting, lambda t: pair(F.lit("folderOpen"), F.trim(F.concat_ws(" ", F.array(_text(t, "$.command")), _list(t, "$.args", "string")))))
    both = F.concat(F.coalesce(hooked, F.array().cast("array<struct<event:string,command:string>>")), tasks)
    return F.filter(both, lambda c: c["command"] != "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[0-9a-z_]+"), F.lit(0))


def any_word(text: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(words(text), F.array(*[F.lit(w) for w in wanted]))


def fetches(low: Column) -> Column:
    """Whether a command (in lower case) hands on what it fetches: a fetching program stands before an operator, or curl or
    wget stands before a program that runs scripts in the same line."""
    plain = F.regexp_replace(low, "(^|[^0-9a-z_])invoke-webrequest", "$1iwr")
    steps = F.split(plain, "[|;&]")
    handed = F.exists(F.slice(steps, 1, F.size(steps) - 1), lambda step: any_word(step, FETCHERS))
    places = lambda line, wanted: F.filter(F.transform(words(line), lambda w, i: F.when(w.isin(wanted), i)), lambda i: i.isNotNull())
    run = F.exists(F.split(plain, "\n"), lambda line: F.coalesce(F.array_min(places(line, FETCHERS[:2])) < F.array_max(places(line, RUNNERS)), F.lit(False)))
    return handed | run


def odd_place(low: Column) -> Column:
    """Whether a command (in lower case) names a folder that programs are not kept in."""
    return F.exists(F.array(*[F.lit(p) for p in ODD_PATHS]), lambda p: F.contains(low, p)) | any_word(low, ["appdata"])


def unattended(command: Column) -> Column:
    """AUTO-001 fetches and runs, AUTO-002 interpreter on an odd path, AUTO-003 interpreter; else null. The first holds."""
    low = F.lower(command)
    runs = any_word(low, INTERPRETERS)
    return F.when(fetches(low), "AUTO-001").when(runs & odd_place(low), "AUTO-002").when(runs, "AUTO-003")


def tool_codes(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """key, code, severity of tools (key, description, sha256) against what was recorded (key, sha256): TOOL-001 changed, 002
    not recorded, 003 no longer there, and what the content rules find in each current description, as TOOL- codes. One
    full outer join and one scan of the descriptions; null descriptions hold nothing."""
    state = drift(recorded.select("key", "sha256"), current.select("key", "sha256"))
    code = F.when(F.col("state") == "changed", "TOOL-001").when(F.col("state") == "new", "TOOL-002").otherwise("TOOL-003")
    worth = F.when(F.col("state") == "changed", "high").when(F.col("state") == "new", "medium").otherwise("low")
    told = findings(scan(current.select("key", "description"), "description"), "key")
    return state.select("key", code.alias("code"), worth.alias("severity")).unionByName(told.select("key", F.concat(F.lit("TOOL-"), "rule_id").alias("code"), "severity"))


def settings(configs: DataFrame) -> DataFrame:
    """path, code, severity, n of settings files (path, text): SET-000 unreadable, 001 any shell, 002 commands that send
    (without 001 only), 003 no denials, 005 remote servers, here or in projects; AUTO-001 to 003 by commands nobody starts.
    n counts what was found. Null texts are unreadable."""
    v = configs.select("path", F.try_parse_json("text").alias("v"))
    good = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    granted = F.transform(_list(F.col("v"), "$.permissions.allow", "string"), lambda a: F.lower(F.trim(a)))
    servers = lambda x: F.transform(F.coalesce(_table(x, "$.mcpServers"), F.array().cast("array<struct<key:string,value:variant>>")), lambda e: e["value"])
    nested = F.flatten(F.transform(F.coalesce(_table(F.col("v"), "$.projects"), F.array().cast("array<struct<key:string,value:variant>>")), lambda e: servers(e["value"])))
    remote = lambda s: (_text(s, "$.url") != "") | _text(s, "$.type").isin("sse", "http")
    own = v.select("path", good.alias("good"), granted.alias("granted"), F.size(_list(F.col("v"), "$.permissions.deny")).alias("denied"), F.size(F.filter(F.concat(servers(F.col("v")), nested), remote)).alias("remote"), commands(F.col("v")).alias("commands"))
    count = lambda pattern: F.size(F.filter("granted", lambda a: a.rlike(pattern)))
    auto = F.transform(F.filter("commands", lambda c: c["event"].isin(UNATTENDED)), lambda c: unattended(c["command"]))
    own = own.withColumns({"any": count(ANY_SHELL), "sends": count(SENDS), "auto": auto})
    n = lambda code: F.size(F.filter("auto", lambda a: a == code))
    cases = [
        ("SET-000", "info", ~F.col("good"), F.lit(1)), ("SET-001", "critical", F.col("good") & (F.col("any") > 0), F.col("any")),
        ("SET-002", "medium", F.col("good") & (F.col("any") == 0) & (F.col("sends") > 0), F.col("sends")), ("SET-003", "low", F.col("good") & (F.col("denied") == 0), F.lit(1)),
        ("SET-005", "medium", F.col("remote") > 0, F.col("remote")),
        *[(c, s, n(c) > 0, n(c)) for c, s in (("AUTO-001", "critical"), ("AUTO-002", "critical"), ("AUTO-003", "high"))],
    ]
    found = F.array(*[F.when(test, F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"), k.cast("long").alias("n"))) for c, s, test, k in cases])
    return own.select("path", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("path", "f.*")


def always_applied(text: Column) -> Column:
    """AUTO-004: a rule file that reaches every turn and names an interpreter. The switch is looked for in its first 400
    characters, the interpreter in everything from the first --- there on."""
    head = F.substring(text, 1, 400)
    at = F.instr(head, "---")
    body = F.when(at > 0, F.substring(text, at, F.length(text))).otherwise(text)
    return F.coalesce(head.rlike(ALWAYS) & F.lower(body).rlike(INTERPRETER), F.lit(False))


def writable(files: DataFrame) -> DataFrame:
    """SET-004 for files (path, mode) that their owner may write."""
    return files.where(F.col("mode").bitwiseAND(0o200) != 0).select("path", F.lit("SET-004").alias("code"), F.lit("medium").alias("severity"), F.lit(1).cast("long").alias("n"))


def skills(folders: DataFrame) -> DataFrame:
    """SET-006 for each path with installed skills (path, skill)."""
    return folders.groupBy("path").agg(F.count_distinct("skill").alias("n")).where("n > 0").select("path", F.lit("SET-006").alias("code"), F.lit("info").alias("severity"), "n")


def radius(found: DataFrame, key: str) -> DataFrame:
    """key, execute, persist, propagate, score, band, closed of findings (key, code, n), one row a host."""
    has = {c: F.max(F.col("code") == c).alias(c) for c in ("SET-001", "SET-002", "SET-005", "SET-006")}
    flags = found.groupBy(key).agg(*has.values(), F.coalesce(F.sum(F.when(F.col("code") == "SET-004", F.col("n"))), F.lit(0)).alias("writable"))
    on = lambda c, n: F.when(F.col(f"`{c}`"), n).otherwise(0)
    reach = on("SET-002", 5) + on("SET-005", 3) + on("SET-006", 3)
    links = flags.select(
        key, F.when(F.col("`SET-001`"), 10).when(F.col("`SET-002`"), 4).otherwise(2).alias("execute"),
        F.when(F.col("writable") > 0, F.least(F.lit(10), F.col("writable") + 5)).otherwise(1).cast("int").alias("persist"),
        F.when(reach == 0, 1).otherwise(F.least(F.lit(10), reach)).alias("propagate"),
    )
    score, _ = capability(F.col("execute"), F.col("persist"), F.col("propagate"))
    scored = links.withColumn("score", score)
    _, band = capability(F.col("execute"), F.col("persist"), F.col("propagate"))
    return scored.withColumns({"band": band, "closed": F.least("execute", "persist", "propagate") >= 3})


def snapshot_codes(status: str, baseline: DataFrame, current: DataFrame) -> DataFrame:
    """key, code, severity. status of the record: 'none' gives BASE-000 and 'corrupt' BASE-004 with a null key; 'ok' one row
    a difference: BASE-001 changed, 002 missing, 003 not recorded."""
    spark = current.sparkSession
    kind = current.schema["key"].dataType
    if status != "ok":
        code, severity = {"none": ("BASE-000", "info"), "corrupt": ("BASE-004", "high")}[status]
        return spark.range(1).select(F.lit(None).cast(kind).alias("key"), F.lit(code).alias("code"), F.lit(severity).alias("severity"))
    code = F.when(F.col("state") == "changed", "BASE-001").when(F.col("state") == "missing", "BASE-002").otherwise("BASE-003")
    return drift(baseline, current).select("key", code.alias("code"), F.when(F.col("state") == "missing", "medium").otherwise("high").alias("severity"))


def watched(path: Column) -> Column:
    """Whether a path is a file that agents load as instructions."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    inside = F.arrays_overlap(parts, F.array(*[F.lit(d) for d in INSTRUCTION_DIRS]))
    return F.coalesce(name.isin(INSTRUCTION_FILES) | (name.rlike("[^.].*[.]mdc?$|^[.].+[.]mdc?$") & inside), F.lit(False))


def inbound(tool: Column) -> Column:
    return F.coalesce(tool.isin(INBOUND) | F.startswith(tool, F.lit("mcp__")), F.lit(False))


def outbound(tool: Column) -> Column:
    return F.coalesce(tool.isin(OUTBOUND), F.lit(False))


def named(tool: Column, parts: list[str]) -> Column:
    """Whether a tool's name holds any of the parts, whatever their case."""
    return F.coalesce(F.lower(tool).rlike("|".join(re.escape(p.lower()) for p in parts)), F.lit(False)) if parts else F.lit(False)


def hook_answer(action: Column, reason: Column) -> Column:
    """What a hook before a tool call answers, as JSON: block denies, warn allows with a remark, unread asks; else null."""
    verdict = F.when(action == "block", "deny").when(action == "warn", "allow").when(action == "unread", "ask")
    said = F.struct(
        F.lit("PreToolUse").alias("hookEventName"), verdict.alias("permissionDecision"),
        F.when(action != "warn", reason).alias("permissionDecisionReason"), F.when(action == "warn", reason).alias("additionalContext"),
    )
    return F.when(verdict.isNotNull(), F.to_json(F.struct(said.alias("hookSpecificOutput"))))


def handoffs(calls: DataFrame, order: list[str], tool: str = "tool", text: str = "text") -> DataFrame:
    """Findings in what one agent tells another (rows of spawn tools), as PROP- codes: the first row, in the given order, of
    each rule and text beginning (120 characters). Partial aggregates keep a copied task from becoming one large group."""
    told = scan(calls.where(F.col(tool).isin(SPAWN) & (F.trim(text) != "")), text)
    rows = findings(told.withColumn("__begin", F.substring(text, 1, 120)), *order, "__begin")
    first = rows.groupBy("rule_id", "__begin").agg(F.min(F.struct(*order)).alias("o"), F.min_by("severity", F.struct(*order)).alias("severity"))
    return first.select("o.*", F.concat(F.lit("PROP-"), "rule_id").alias("rule_id"), "severity")


def captures(cleaned: DataFrame, key: str, path: str, at: str) -> DataFrame:
    """One entry for each file out of which something was cut: id, path, captured_at, rules, severity, line, both digests,
    original, restored. cleaned holds key, path, at, body, excised, findings; files that cutting left as they were give none."""
    order = F.array(*[F.lit(s) for s in ("critical", "high", "medium", "low", "info")])
    found = cleaned.where((F.size("findings") > 0) & ~F.col("body").eqNullSafe(F.col("excised")))
    worst = F.get(order, (F.array_min(F.transform("findings", lambda f: F.array_position(order, f["severity"]))) - 1).cast("int"))
    digest = F.sha2("body", 256)
    return found.select(
        F.substring(F.sha2(F.concat_ws("\n", F.col(path).cast("string"), digest), 256), 1, 16).alias("id"), F.col(key), F.col(path).alias("path"), F.col(at).alias("captured_at"),
        F.array_sort(F.array_distinct(F.col("findings.rule_id"))).alias("rules"), worst.alias("severity"), F.get(F.col("findings.line"), F.lit(0)).alias("line"),
        digest.alias("original_sha256"), F.sha2("excised", 256).alias("cleaned_sha256"), F.col("body").alias("original"), F.lit(False).alias("restored"),
    )


def restore(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (id) with status restored, already_restored, payload_missing or not_found, path and the original text; ids
    asked for twice answer once."""
    hit = wanted.select("id").distinct().join(entries.select("id", "path", "original", "restored"), "id", "left")
    status = F.when(F.col("restored").isNull(), "not_found").when(F.col("restored"), "already_restored").when(F.col("original").isNull(), "payload_missing").otherwise("restored")
    return hit.select("id", status.alias("status"), "path", F.when(status == "restored", F.col("original")).alias("original"))


def capture_summary(entries: DataFrame, most: int = 10) -> DataFrame:
    """kind, name, n over entries (rules, severity, path, day, restored): captured, restored, rule, solo, severity, day, and
    the `most` frequent targets. All come from one pass over exploded labels; only target names are many, and they are
    counted before they are ranked. Counts are written first, as both of their uses would make the entries anew."""
    label = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("name"))
    live = F.concat(
        F.transform("rules", lambda r: label("rule", r)), F.when(F.size("rules") == 1, F.transform("rules", lambda r: label("solo", r))).otherwise(F.array().cast("array<struct<kind:string,name:string>>")),
        F.array(label("captured", F.lit("")), label("severity", F.col("severity")), label("day", F.col("day")), label("target", F.element_at(F.split("path", "/"), -1))),
    )
    labels = F.when(F.col("restored"), F.array(label("restored", F.lit("")))).otherwise(live)
    counts = settled(entries.select(F.explode(labels).alias("l")).groupBy("l.kind", "l.name").agg(F.count("*").alias("n")), "labels")
    targets = counts.where("kind = 'target'").orderBy(F.desc("n"), "name").limit(most)
    return counts.where("kind <> 'target'").unionByName(targets)


def rollup(rows: DataFrame, group: list[str], found: DataFrame, key: list[str]) -> DataFrame:
    """group, signatures, memos, memo_percent, flagged, flagged_percent of rows (group, key, memo, null where there is none).
    found holds the keys with any finding, each once."""
    marked = rows.join(found.select(*key, F.lit(True).alias("hit")), key, "left")
    n = marked.groupBy(*group).agg(F.count("*").alias("signatures"), F.count("memo").alias("memos"), F.count_if(F.col("hit") & F.col("memo").isNotNull()).alias("flagged"))
    share = lambda a, b, d: F.coalesce(F.round(F.try_divide(F.col(a) * 100.0, F.col(b)), d), F.lit(0.0))
    return n.withColumns({"memo_percent": share("memos", "signatures", 4), "flagged_percent": share("flagged", "memos", 6)})


def header(value: Column) -> Column:
    """(scheme, readable) of a payment header: JSON in base64 or plain; the scheme stands under accepted, or at the top."""
    plain = lambda t: F.try_parse_json(t)
    decoded = F.when(value.rlike("^[A-Za-z0-9+/_-]+=*$"), F.make_valid_utf8(F.try_to_binary(F.translate(value, "-_", "+/"), F.lit("base64")).cast("string")))
    v = F.coalesce(plain(decoded), plain(value))
    return F.struct(F.coalesce(F.try_variant_get(v, "$.accepted.scheme", "string"), F.try_variant_get(v, "$.scheme", "string")).alias("scheme"), F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)).alias("readable"))


def header_decision(head: Column) -> Column:
    """Abstains unless the header is an object whose scheme is the one that can be checked."""
    return F.when(~head["readable"], "abstain:unreadable").when(head["scheme"].isNull(), "abstain:no scheme").when(head["scheme"] != "exact", "abstain:scheme").otherwise("check")


def explained(found: DataFrame, sessions: DataFrame, key: str) -> DataFrame:
    """Findings of changed and unrecorded files (BASE-001, 003) with the session in which they were written; others as they are."""
    told = F.col("code").isin("BASE-001", "BASE-003")
    return found.join(sessions, key, "left").withColumns({c: F.when(told, F.col(c)) for c in sessions.columns if c != key})
