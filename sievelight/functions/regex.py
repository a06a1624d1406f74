"""Patterns written for JavaScript or as globs, made into Java regexes."""

from __future__ import annotations

_WORD = "[0-9A-Za-z_]"
#: A word boundary that knows ASCII letters alone; Java's own sees accented letters too.
ASCII_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


#: The same where a word character is known to follow: one look back, which fails at once inside words.
WORD_START = f"(?<!{_WORD})"


def _begins_with_word(rest: str) -> bool:
    """Whether what follows a leading boundary can only begin with a word character."""
    depth, firsts = 0, [0]
    for i, c in enumerate(rest):
        if c == "|" and depth == 0:
            return False  # the boundary belongs to the first alternative alone
        if c == "(" and i == 0:
            firsts = [1]
        if c == "|" and depth == 1 and firsts[0] == 1:
            firsts.append(i + 1)
        if i == 0 or rest[i - 1] != "\\":
            depth += (c == "(") - (c == ")")
            if depth == 0 and firsts[0] == 1 and c == ")":
                optional = rest[i + 1 : i + 2] in ("?", "*", "{")
                return not optional and all(rest[f].isascii() and (rest[f].isalnum() or rest[f] == "_") and rest[f + 1 : f + 2] not in ("?", "*", "{") for f in firsts)
    return bool(rest) and rest[0].isascii() and rest[0].isalnum() and rest[1:2] not in ("?", "*", "{")


def ascii_words(pattern: str) -> str:
    r"""The pattern with each \b replaced by the ASCII boundary. A \\b (an escaped backslash) is left alone."""
    out, at = [], 0
    if pattern.startswith(r"\b") and _begins_with_word(pattern[2:]):
        out, at = [WORD_START], 2
    while at < len(pattern):
        pair = pattern[at : at + 2]
        out.append(ASCII_BOUNDARY if pair == r"\b" else pair if pair[:1] == "\\" else pair[:1])
        at += 2 if pair[:1] == "\\" else 1
    return "".join(out)


def any_of(patterns: list[str]) -> str:
    """One case-insensitive pattern for all; where all begin at a word's start, that is looked for once."""
    done = [ascii_words(p) for p in patterns]
    if all(d.startswith(WORD_START) for d in done):
        return f"(?i){WORD_START}(?:" + "|".join(d[len(WORD_START) :] for d in done) + ")"
    return "(?i)(?:" + "|".join(f"(?:{d})" for d in done) + ")"


def _escaped(c: str) -> str:
    return "\\" + c if c in r"\.+^$()[]{}|?*" else c


def glob_regex(glob: str) -> str:
    """A path glob as a regex: `**/` any directories, `**` anything, `*` and `?` within one name, `{a,b}` a choice."""
    out, at, depth = [], 0, 0
    while at < len(glob):
        if glob.startswith("**/", at) and (at == 0 or glob[at - 1] == "/"):
            out.append("(?:.*/)?")
            at += 3
        elif glob.startswith("**", at):
            out.append(".*")
            at += 2
        else:
            c = glob[at]
            at += 1
            if c == "{" and "}" in glob[at:]:
                out.append("(?:")
                depth += 1
            elif c == "}" and depth:
                out.append(")")
                depth -= 1
            elif c == "," and depth:
                out.append("|")
            else:
                out.append({"*": "[^/]*", "?": "[^/]"}.get(c) or _escaped(c))
    return "^" + "".join(out) + "$"


def callee_glob_regex(glob: str) -> str:
    """A callee pattern: `*` is any run without a slash, the rest is literal."""
    return "^" + "".join("[^/]*" if c == "*" else _escaped(c) for c in glob) + "$"
