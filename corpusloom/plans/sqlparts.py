"""Fragments shared by the reference SQL texts."""

# White space as JavaScript sees it, in RE2 syntax.
WS = "[\\s\\x0B\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def file_name(x: str) -> str:
    return f"CASE WHEN {x} LIKE '%/' THEN {x} ELSE regexp_extract({x}, '[^/]*$') END"


def ext(x: str) -> str:
    """Lower-case extension, empty without a dot."""
    return f"regexp_extract(lower({file_name(x)}), '\\.([^.]*)$', 1)"


def words(x: str, alternatives: str) -> str:
    return f"regexp_matches({x}, '(?i)\\b(?:{alternatives})\\b')"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def norm_path(x: str) -> str:
    return f"regexp_replace(replace({x}, '\\', '/'), '^/+', '')"


def parts(x: str) -> str:
    return f"list_filter(string_split({x}, '/'), lambda p: p <> '')"


def uncategorized(x: str) -> str:
    p = parts(f"regexp_replace({x}, '(?i)^notes/', '')")
    return f"(len({p}) <= 1 OR lower({p}[1]) IN ('untitled', 'notes', 'misc', 'general', 'tmp', 'temp'))"


def title(x: str) -> str:
    """Safe, never empty file title."""
    bare = strip(f"regexp_replace(regexp_replace(regexp_extract({x}, '[^/]*$'), '\\.[^/.]+$', ''), '[/\\\\:*?\"<>|]', '-', 'g')")
    return f"coalesce(nullif({bare}, ''), 'Note')"


def structured(x: str) -> str:
    r = f"regexp_replace({norm_path(x)}, '(?i)^notes/', '')"
    return (
        f"(len({parts(r)}) >= 2 AND NOT {uncategorized(r)} AND (len({parts(r)}) >= 3 "
        f"OR NOT regexp_full_match({title(r)}, '(?i)(untitled|note|new note|(untitled|note) .*)')))"
    )


def level(current: str, target: str) -> str:
    c, t = parts(f"lower({current})"), parts(f"lower({target})")
    return (
        f"CASE WHEN {uncategorized(current)} THEN 'strong' WHEN {c} = {t} THEN 'optional' "
        f"WHEN {c}[1] = {t}[1] AND ((len({c}) >= 3 AND len({t}) >= 3) OR len({c}) = len({t})) THEN 'optional' "
        f"ELSE 'recommended' END"
    )
