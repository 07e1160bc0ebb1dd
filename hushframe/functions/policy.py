"""Egress policy of tools: ordered rules over a tool's name, closed where nothing fits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe.functions import grammar, taxonomy

# Known tools and the hints in names.
LOCAL_TOOLS = ("read_file", "list_dir", "find_files", "grep", "file_state")
SIDE_EFFECT_TOOLS = ("write_file", "edit_file", "apply_patch", "exec", "write_stdin", "list_exec_sessions", "shell", "cron", "message", "spawn", "long_task", "complete_goal", "my", "loader")
EXTERNAL_TOOLS = ("web_fetch", "web_search", "generate_image")
CLI_TOOLS = ("run_cli_app",)
NETWORK_HINTS = ("web_", "_web", "http", "fetch", "search", "browse", "crawl", "remote", "upload", "download", "publish", "post_", "api_", "url", "image_gen", "generate_image")
LOCAL_HINTS = ("read_file", "list_dir", "find_file", "grep", "glob", "stat_", "file_state")


def _any(c: Column, hints) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(h)) for h in hints])


#: Decision on a tool's name: its class, and whether a call waits for approval. Overrides come in the same form.
Overrides = dict[str, "str | tuple[str, bool]"]


def _decision(name: Column, overrides: Overrides | None, field: int) -> Column:
    """Class (field 0) or approval (field 1) of a name by the first rule that fits; an override without a flag needs no approval."""
    name = F.trim(F.coalesce(name, F.lit("")))
    low = F.lower(name)
    rules = [(name == "", ("external", True))]
    rules += [(name == k, v if isinstance(v, tuple) else (v, False)) for k, v in (overrides or {}).items() if k]
    rules += [
        (name.isin(*CLI_TOOLS) | name.startswith("mcp_") | name.isin(*EXTERNAL_TOOLS), ("external", True)),
        (name.isin(*LOCAL_TOOLS), ("local", False)),
        (name.isin(*SIDE_EFFECT_TOOLS), ("side_effect", False)),
        (_any(low, NETWORK_HINTS), ("external", True)),
        (_any(low, LOCAL_HINTS), ("local", False)),
    ]
    return reduce(lambda rest, rule: F.when(rule[0], F.lit(rule[1][field])).otherwise(rest), reversed(rules), F.lit(("external", True)[field]))


def privacy_class(name: Column, overrides: Overrides | None = None) -> Column:
    """local, side_effect or external; a name that no rule knows is external."""
    return _decision(name, overrides, 0)


def requires_approval(name: Column, overrides: Overrides | None = None) -> Column:
    """Whether a call waits for approval: an override says so itself, all other external tools do."""
    return _decision(name, overrides, 1)


def cli_app_allowed(app: Column, allowed: tuple[str, ...] = ()) -> Column:
    """Whether an application is on the list of those allowed; an empty list allows none."""
    return F.trim(F.coalesce(app, F.lit(""))).isin(*allowed) if allowed else F.lit(False)


def fallback_permitted(prompt: Column, identifiers: Column, allowed: tuple[str, ...] = ()) -> Column:
    """Whether another provider may see a prompt: always without severe tokens, else only one with an identifier on the list."""
    listed = F.coalesce(F.arrays_overlap(identifiers, F.array(*map(F.lit, allowed))), F.lit(False)) if allowed else F.lit(False)
    return ~F.coalesce(high_severity_prompt(prompt), F.lit(False)) | listed


def high_severity_prompt(text: Column, parity: bool = False) -> Column:
    """Whether a prompt holds a token of a severe type. parity: compare lower-cased tags with slugs, as first built."""
    found = grammar.tags(text)
    known = F.array(*[F.lit(x) for x in sorted(taxonomy.TAGS if parity else taxonomy.SLUGS)])
    return F.arrays_overlap(F.transform(found, F.lower) if parity else found, known)


def needs_gate(name: Column, arguments: Column, severe_local: bool = False) -> Column:
    """A call waits for approval if it leaves the host, or if its class isn't local and its arguments hold tokens.

    arguments: text, or a nested value, which is searched as JSON. severe_local: tokens of a severe type hold up local calls too.
    """
    kind = privacy_class(name)
    gate = (kind == "external") | ((kind != "local") & arguments.rlike(grammar.PLACEHOLDER))
    return gate | high_severity_prompt(arguments) if severe_local else gate


def holds_placeholder(value: Column) -> Column:
    """Whether a nested value (struct, map, array or variant) holds a token anywhere."""
    return F.to_json(value).rlike(grammar.PLACEHOLDER)
