"""Text rules as Column expressions: tokens, snippets, titles, noise, pastes, names, paths."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

CONTENT_CAP = 8000
SNIPPET_WINDOW = 240


def _fold_table() -> tuple[str, str]:
    """Accented Latin lower-case letters and their base letters, from canonical decomposition."""
    source, target = [], []
    for code in range(0xC0, 0x250):
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        if len(parts) > 1 and char == char.lower() and all(unicodedata.combining(p) for p in parts[1:]):
            source.append(char)
            target.append(parts[0])
    return "".join(source), "".join(target)


FOLD_FROM, FOLD_TO = _fold_table()


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def first_code_points(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def tokenized(text: Column) -> Column:
    """Lower-cased, accent-folded letter and digit runs, joined by one space."""
    folded = F.translate(F.lower(text), FOLD_FROM, FOLD_TO)
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(tokenized(text), " "), lambda t: t != "")


def token_estimate(text: Column) -> Column:
    return F.ceil(F.char_length(text) * F.lit(0.3)).cast("bigint")


def snippet(content: Column, terms: Column, window: int = SNIPPET_WINDOW) -> Column:
    """``window`` code points around the earliest term; the content itself where it fits."""
    size = max(1, int(window))
    total = F.char_length(content)

    def places(lowered: Column) -> Column:
        return F.transform(
            terms,
            lambda t, i: F.struct(
                F.call_function("instr", lowered, F.lower(t)).alias("at"),
                i.alias("i"),
                F.char_length(t).alias("n"),
            ),
        )

    # The content is put in lower case once, not once per term.
    once = F.element_at(F.transform(F.array(F.lower(content)), places), 1)
    found = F.filter(once, lambda hit: (hit["at"] > 0) & (hit["n"] > 0))
    best = F.array_min(found)
    centre = best["at"] - 1 + F.floor(best["n"] / 2) - F.lit(size // 2)
    start = F.greatest(F.lit(0), F.least(F.coalesce(centre, F.lit(0)), total - size)).cast("int")
    body = F.substring(content, start + 1, F.lit(size))
    cut = F.concat(
        F.when(start > 0, "…").otherwise(""), body, F.when(start + size < total, "…").otherwise("")
    )
    return F.when(total <= size, content).otherwise(cut)


def title(text: Column, limit: int = 80) -> Column:
    sentence = strip(F.split(collapse(text), "[。！？!?]")[0])
    return F.when(F.char_length(sentence) <= limit, sentence).otherwise(
        F.concat(F.substring(sentence, 1, limit - 3), F.lit("..."))
    )


# Altitude patterns, tried in order.
ALTITUDE_PATTERNS = [
    ("mission", r"(?i)mission|ミッション|ビジョン|vision|product\s+direction|事業方針"),
    ("strategy", r"(?i)strategy|戦略|方針|positioning|GTM|go.to.market|revenue|pricing|ICP|ターゲット|マーケ"),
    ("architecture", r"(?i)architect|設計|schema|database|DB設計|migration|API\s+design|system\s+design|layer\s+model|アーキテクチャ"),
]


def altitude(text: Column) -> Column:
    out = F.lit("implementation")
    for name, pattern in reversed(ALTITUDE_PATTERNS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


# Openings and phrases that mark a turn as machinery, not speech.
NOISE_PREFIXES = [
    "<local-command-realize>",
    "<system-reminder>",
    "<command-message>",
    "<command-name>",
    "<scheduled-task",
    "<automated-",
    "<bash-",
    "<ide-",
    "<task-notification>",
    "<local-command-stdout>",
    "<local-command-stderr>",
    "<command-stdout>",
    "<command-stderr>",
    "This session is being continued from a previous conversation",
]
NOISE_PHRASES = [
    "Realize: The messages below were generated by the user while running local commands",
    "The TodoWrite tool hasn't been used recently",
    "PostToolUse:Write hook",
]
SLASH_COMMAND = r"^/(compact|clear|exit|help|quit|login|logout|mcp)(\s|$)"


def is_noise(text: Column) -> Column:
    t = strip(F.coalesce(text, F.lit("")))
    verdict = (t == "") | t.rlike(SLASH_COMMAND)
    for prefix in NOISE_PREFIXES:
        verdict = verdict | t.startswith(prefix)
    for phrase in NOISE_PHRASES:
        verdict = verdict | t.contains(phrase)
    return verdict


AUTOMATED = r"^\s*<scheduled-task|^\s*<automated-"

# Paste rules as (name, leading code points looked at or 0 for all, pattern).
CLOCK_STAMP = r"\d{1,2}:\d{2}:\d{2}[.:]\d{2,3}"
PASTE_PATTERNS = [
    ("bullet", 0, r"^[●○◯◆■▶►]\s"),
    ("attempt", 0, r"(?i)^Attempt #\d+ failed"),
    ("box_drawing", 200, r"[┌┐└┘├┤┬┴┼━─│]"),
    ("system_prompt", 0, r"^You are (a|an|the) [A-Z]\w+"),
    ("greeting", 0, r"(?i)^(Welcome to|Hey there,|Hi there,|Dear)\s"),
    ("admin", 0, r"(?i)^(Add|Enable|Disable|Configure) (organization|2FA|members|users)"),
    ("status", 80, r"^(Service offline|Failed|Success|Deployment|Build|Logs?|Error:)"),
    ("clock_line", 0, r"^" + CLOCK_STAMP + r"\s"),
    ("clock_stamps", 0, CLOCK_STAMP),
    ("deployed", 0, r"^成功しました"),
    ("boilerplate", 0, r"^Review errors before repeating this workflow\.$"),
    ("forum_rule", 200, r"Rule \d+:"),
    ("stack_trace", 500, r"(?m)^\s*at\s+\w+.*\(.*:\d+:\d+\)"),
]


def paste_rule(text: Column) -> Column:
    """Name of the first paste rule that holds, or null."""
    t = strip(F.coalesce(text, F.lit("")))
    rules = []
    for name, head, pattern in PASTE_PATTERNS:
        looked_at = F.substring(t, 1, head) if head else t
        holds = looked_at.rlike(pattern)
        if name == "box_drawing":
            holds = holds & (F.char_length(t) > 100)
        elif name == "clock_stamps":
            holds = F.regexp_count(t, F.lit(pattern)) >= 3
        elif name == "deployed":
            holds = holds & F.substring(t, 1, 200).rlike(r"(?i)デプロイ|deploy")
        elif name == "forum_rule":
            holds = holds & t.rlike(r"(?i)your (post|submission)")
        rules.append(F.when(holds, name))
    return F.coalesce(*rules)


# Replies that carry no request.
ACKNOWLEDGEMENTS = [
    "y", "yes", "ok", "okay", "continue", "next", "go on", "proceed", "done",
    "はい", "うん", "了解", "続けて", "次へ", "okです", "お願いします",
]


def triage_reason(prompt: Column) -> Column:
    t = collapse(F.coalesce(prompt, F.lit("")))
    return (
        F.when(t == "", "empty")
        .when(is_noise(t), "meta")
        .when(F.lower(t).isin(ACKNOWLEDGEMENTS), "acknowledgement")
        .when(F.char_length(t) < 4, "too_short")
        .otherwise("meaningful")
    )


# Where a name in camel case is cut.
CAMEL_CUTS = [r"([a-z])([A-Z])", r"([A-Z]+)([A-Z][a-z])"]


def normalize_name(name: Column) -> Column:
    out = name
    for pattern in CAMEL_CUTS:
        out = F.regexp_replace(out, pattern, "$1 $2")
    return collapse(F.lower(F.regexp_replace(out, r"[-_]", " ")))


# Accepted spellings of a layer.
LAYER_ALIASES = {
    "goal": "goal", "context": "context", "emotion": "emotion",
    "implementation": "implementation", "realize": "realize", "learning": "learning",
    "why": "goal", "goals": "goal", "target": "goal", "targets": "goal", "intent": "goal",
    "background": "context", "reason": "context", "situation": "context", "timing": "context",
    "tone": "emotion", "feelings": "emotion", "mood": "emotion",
    "impl": "implementation", "success": "implementation", "failure": "implementation",
    "how": "implementation", "tried": "implementation", "attempts": "implementation",
    "warning": "realize", "warnings": "realize", "pain": "realize", "rule": "realize",
    "rules": "realize", "pitfall": "realize", "pitfalls": "realize", "dont": "realize",
    "decision": "learning", "decisions": "learning", "learned": "learning",
    "insight": "learning", "insights": "learning", "growth": "learning",
}


def resolve_layer(raw: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LAYER_ALIASES.items() for x in pair])
    return F.try_element_at(table, strip(F.lower(raw)))


# Home folders that precede a project folder, and folders that are never a project.
HOME_PREFIXES = [
    r"(?i)^[a-z]:/Users/[^/]+/",
    r"^/Users/[^/]+/",
    r"^/home/[^/]+/",
    r"(?i)^/mnt/[a-z]/Users/[^/]+/",
]
NOT_A_PROJECT = [
    ".claude", ".config", ".cache", ".local", ".vscode", ".git", ".ssh", ".npm",
    "Downloads", "Documents", "Desktop", "Pictures", "Music", "Videos",
    "node_modules", "tmp", "temp", "AppData", "Library",
    "OneDrive", "Dropbox", "Google Drive", "Users", "home",
    "projects", "commands", "skills", "worktrees", "hooks", "agents", "plugins",
    "settings", "memory", "todos", "shell-snapshots", "ide",
]


def project_of_path(path: Column) -> Column:
    slashed = F.regexp_replace(path, r"\\", "/")
    below_home = F.coalesce(*[F.when(slashed.rlike(p), F.regexp_replace(slashed, p, "")) for p in HOME_PREFIXES])
    folders = F.filter(
        F.split(below_home, "/"),
        lambda s: (s != "")
        & ~s.isin(NOT_A_PROJECT)
        & ~s.startswith(".")
        & ~s.rlike(r"(?i)\.[a-z0-9]{1,5}$")
        & ~s.rlike(r"^[A-Z]--"),
    )
    return F.when(~slashed.contains("/.claude/"), F.get(folders, F.lit(0)))


def last_folder(cwd: Column) -> Column:
    parts = F.filter(F.split(F.regexp_replace(cwd, r"\\", "/"), "/"), lambda s: s != "")
    return F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise("unknown")


def shape_key(content: Column) -> Column:
    """Sorted top-level keys of a JSON object; null for text, arrays, invalid or empty objects."""
    keys = F.json_object_keys(F.when(F.ltrim(content).startswith("{"), content))
    return F.when(F.size(keys) > 0, F.array_join(F.array_sort(keys), "|"))


def utc_day(epoch: Column) -> Column:
    """The UTC date of epoch seconds as text, whatever the time zone of the session."""
    days = F.floor(epoch / F.lit(86_400)).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string")


def iso_instant(epoch: Column) -> Column:
    seconds = F.pmod(epoch.cast("bigint"), F.lit(86_400))
    clock = [F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60]
    return F.when(epoch.isNotNull(), F.format_string("%sT%02d:%02d:%02dZ", utc_day(epoch), *clock))
