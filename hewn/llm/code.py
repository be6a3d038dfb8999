"""Source-code scanner shared by the code operators: functions, classes and their documentation.

Strings and comments are first masked (same length, one placeholder per
character), so that recursive patterns see only real code. A recursive pattern
then takes the lines above, the signature and the balanced body of a member in
one match.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import regex

COMMENT, STRING = "\x01", "\x02"

# File extensions and spellings of the languages.
FAMILY_OF = {
    "py": "python", "pyi": "python", "python": "python", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "javascript": "js",
    "ts": "js", "tsx": "js", "typescript": "js", "go": "go", "golang": "go", "rs": "rust", "rust": "rust", "java": "java",
}

_TOKENS = {
    "python": re.compile(
        r"#[^\n]*|\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*(?:\"\"\"|\Z)|'''(?:[^\\']|\\[\s\S]|'(?!''))*(?:'''|\Z)"
        r"|\"(?:[^\"\\\n]|\\[\s\S])*(?:\"|(?=\n)|\Z)|'(?:[^'\\\n]|\\[\s\S])*(?:'|(?=\n)|\Z)"
    ),
    "js": re.compile(
        r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\[\s\S])*(?:\"|(?=\n)|\Z)|'(?:[^'\\\n]|\\[\s\S])*(?:'|(?=\n)|\Z)|`(?:[^`\\]|\\[\s\S])*(?:`|\Z)"
    ),
    "go": re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*(?:\"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.[^'\n]*)'|`[^`]*(?:`|\Z)"),
    "rust": re.compile(
        r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|(?<!\w)b?r(?P<h>#+)\"[\s\S]*?(?:\"(?P=h)|\Z)|(?<!\w)b?r\"[^\"]*(?:\"|\Z)|\"(?:[^\"\\]|\\[\s\S])*(?:\"|\Z)|'(?:[^'\\\n]|\\[^\n][^'\n]*)'"
    ),
    "java": re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"\"\"[\s\S]*?(?:\"\"\"|\Z)|\"(?:[^\"\\\n]|\\.)*(?:\"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.[^'\n]*)'"),
}

_PAR = r"(?P<par>\((?:[^()]++|(?&par))*+\))"
_BODY = r"(?P<body>\{(?:[^{}]++|(?&body))*+\})"
_NAME = r"(?P<name>[^\W\d][\w$]*+)"
_PRE = r"(?P<pre>(?:[^\S\n]*+(?:\x01++|@[\w.$]++(?:[^\S\n]*+(?&par))?+|#!?\[[^\]]*+\])[^\S\n]*+\n?)*+)"
_TYPE_PARAMS = r"(?:<[^;{}()]*?>)?"
#: Words that look like a method before a block.
_NOT_NAMES = frozenset(
    "if for while switch catch return with function new else do try throw await typeof delete super constructor_ match loop unsafe synchronized".split()
)

_JS_FUNCTION = rf"(?:export\s+)?+(?:default\s+)?+(?:declare\s+)?+(?:async\s+)?+function\b\s*+\*?\s*+{_NAME}\s*+{_TYPE_PARAMS}\s*+{_PAR}[^{{;]*+{_BODY}"
_JS_BOUND = (
    rf"(?:export\s+)?+(?:const|let|var)\s++{_NAME}\s*+(?::[^=\n]++(?:=>[^=\n]++)?)?=\s*+(?:async\s+)?+"
    rf"(?:function\b\s*+\*?\s*+\w*+\s*+{_PAR}[^{{;]*+{_BODY}|(?:{_TYPE_PARAMS}\s*+(?&par)[^={{;]*+|[\w$]++\s*+)=>\s*+(?:(?&body)|(?P<expr>[^\n]*+)))"
)
_JS_METHOD = (
    rf"(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*+\*?\s*+\#?{_NAME}\s*+{_TYPE_PARAMS}\s*+{_PAR}"
    rf"(?:\s*+:[^;{{}}=]*+)?\s*+{_BODY}"
)
_RECURSIVE = {
    "js": [_JS_FUNCTION, _JS_BOUND, _JS_METHOD],
    "go": [rf"func\b\s*+(?:\([^()]*+\)\s*+)?{_NAME}\s*+(?:\[[^\]]*+\]\s*+)?{_PAR}[^{{\n]*+{_BODY}"],
    "rust": [
        rf"(?:pub\b(?:\s*\([^()]*+\))?\s+)?+(?:(?:default|const|async|unsafe|extern)\s+(?:\x02++\s*+)?)*+fn\s++{_NAME}\s*+{_TYPE_PARAMS}\s*+{_PAR}[^{{;]*+{_BODY}"
    ],
    "java": [
        rf"(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s+)*+(?:<[^;{{}}()]*?>\s*+)?"
        rf"(?!(?:return|new|else|throw|case|assert|yield)\b)(?:[\w.$]++(?:\s*<[^;{{}}()]*?>)?+(?:\s*\[\s*\])*+\s+)?+{_NAME}\s*+{_PAR}\s*+(?:throws\s[^{{;]*+)?{_BODY}"
    ],
}
_PATTERN = {k: [regex.compile(_PRE + r"[^\S\n]*+" + x, regex.V1) for x in v] for k, v in _RECURSIVE.items()}
_PATTERN["python"] = [
    regex.compile(
        _PRE + r"(?P<ind>[^\S\n]*+)(?:async[^\S\n]++)?def[^\S\n]++" + _NAME + r"[^\S\n]*+(?:\[[^\]]*+\])?" + _PAR + r"[^:\n]*+:"
        r"(?P<body>(?:[^\S\n]*+(?:\x01++)?\n)*+[^\S\n]*+(?P<lit>[rRuU]?+\x02++(?=[^\S\n]*+(?:\n|;|\x01|\Z)))?+[^\n]*+"
        r"(?:\n(?:(?P=ind)[^\S\n]++[^\s][^\n]*+|[^\S\n]*+(?=\n)|(?P=ind)[^\S\n]*+\)[^\n]*+))*+)",
        regex.V1,
    )
]
# Where a member may begin; the recursive pattern decides.
_CANDIDATE = {
    "python": re.compile(r"^[^\S\n]*(?:async[^\S\n]+)?def\b", re.M),
    "go": re.compile(r"^[^\S\n]*func\b", re.M),
    "rust": re.compile(r"^[^\S\n]*(?:pub\b(?:\s*\([^()\n]*\))?\s+)?(?:(?:default|const|async|unsafe|extern)\s+(?:\x02+\s*)?)*fn\b", re.M),
    "java": re.compile(r"^[^\S\n]*(?!(?:if|for|while|switch|catch|return|throw|new|else|try)\b)(?:[\w.$<>\[\],?]+[^\S\n]+)*[\w$]+[^\S\n]*\([^\n]*[^;\n]$", re.M),
    "js": re.compile(
        r"^[^\S\n]*(?:(?P<k0>(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\b)"
        r"|(?P<k1>(?:export\s+)?(?:const|let|var)\s+[\w$]+[^=\n;]*=\s*(?:async\b|function\b|\([^\n]*(?:=>|[^;])\s*$|<|[\w$]+\s*=>))"
        r"|(?P<k2>(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*[\*#]?(?!(?:if|for|while|switch|catch|return|function)\b)[\w$]+\s*(?:<[^;{}()\n]*>)?\s*\([^\n]*[^;\n]$))",
        re.M,
    ),
}
_CLASS = {
    "python": re.compile(r"^(?P<ind>[^\S\n]*)class\s+(?P<name>\w+)", re.M),
    "js": re.compile(r"^[^\S\n]*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?class\s+(?P<name>[\w$]+)[^{;]*(?=\{)", re.M),
    "java": re.compile(
        r"^[^\S\n]*(?:(?:public|private|protected|static|final|abstract|sealed|strictfp)\s+)*(?:class|interface|enum|record|@interface)\s+(?P<name>[\w$]+)[^{;]*(?=\{)", re.M
    ),
    "rust": re.compile(r"^[^\S\n]*(?:pub\b(?:\s*\([^()\n]*\))?\s+)?(?:unsafe\s+)?(?:impl|struct|trait|enum)\b[^{;]*?(?P<name>\w+)[^{;\w]*(?=\{)", re.M),
    "go": re.compile(r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+(?:struct|interface)\s*(?=\{)", re.M),
}
_BLOCK = regex.compile(_BODY, regex.V1)
_PY_BLOCK = regex.compile(r"[^\n]*+(?:\n(?:(?P<ind>[^\S\n]++)[^\s][^\n]*+|[^\S\n]*+(?=\n)|[^\S\n]*+\)[^\n]*+))*+")
_ABOVE = re.compile(r"[^\S\n]*(?:\x01+|@[\w.$]+[^\n]*|#!?\[[^\n]*\])[^\S\n]*\Z")
_CLOSING = re.compile(r"[^\S\n]*\)[^\S\n]*\Z")
_DECORATOR = re.compile(r"[^\S\n]*@")


@dataclass
class Member:
    name: str
    start: int  # of the first decorator, attribute or comment directly above
    sig: int  # of the signature's line
    end: int
    is_class: bool
    above: tuple[tuple[int, int], ...] = ()  # comments and #[doc] attributes above
    literal: tuple[int, int] | None = None  # the literal that opens the body
    body: int = 0


def family(path: str | None, language: str | None) -> str | None:
    """The language family, from the file extension, else from the language's spelling; null if neither is known."""
    ext = path.rsplit(".", 1)[-1].strip().lower() if path and "." in path else ""
    return FAMILY_OF.get(ext) or FAMILY_OF.get((language or "").strip().lower())


def unify(content: str) -> str:
    """Line ends as \\n; line numbers stay."""
    return content.replace("\r\n", "\n").replace("\r", "\n") if "\r" in content else content


def mask(text: str, lang: str) -> str:
    """``text`` with every character of a comment or string replaced by a placeholder, line ends inside them included."""

    def fill(m: re.Match) -> str:
        t = m[0]
        return (COMMENT if t[0] == "#" or t[:2] in ("//", "/*") else STRING) * len(t)

    return _TOKENS[lang].sub(fill, text)


def _block_start(masked: str, line: int) -> int:
    """The start of the run of decorator, attribute and comment lines directly above the line that begins at ``line``."""
    at = line
    while at > 0:
        prev = masked.rfind("\n", 0, at - 1) + 1
        seg = masked[prev : at - 1]
        if _ABOVE.match(seg):
            at = prev
        elif _CLOSING.match(seg):  # the end of a decorator of several lines, however many
            back, depth = prev, seg.count(")") - seg.count("(")
            while back > 0 and depth > 0:
                below, back = back, masked.rfind("\n", 0, back - 1) + 1
                depth += masked.count(")", back, below) - masked.count("(", back, below)
            if depth or not _DECORATOR.match(masked, back):
                break
            at = back
        else:
            break
    return at


_PRE_PART = regex.compile(r"\x01++|#!?\[[^\]]*+\]")


def functions(text: str, masked: str, lang: str) -> list[Member]:
    """Every function and method that begins a line, in order; nested ones as well, those in strings not."""
    out = []
    for c in _CANDIDATE[lang].finditer(masked):
        line = c.start()
        start = _block_start(masked, line)
        m = None
        for p in _PATTERN[lang] if lang != "js" else (_PATTERN["js"][int(c.lastgroup[1])],):
            for at in (start, line) if start != line else (line,):
                m = p.match(masked, at)
                if m and m.start("name") >= line and m["name"] not in _NOT_NAMES:
                    break
                m = None
            if m:
                break
        if not m:
            continue
        above = tuple(
            (start + k.start(), start + k.end())
            for k in _PRE_PART.finditer(masked[start:line])
            if masked[start + k.start()] == COMMENT or text.startswith("#[doc", start + k.start())
        )
        lit = m.span("lit") if lang == "python" and m["lit"] else None
        out.append(Member(m["name"], start, line, m.end(), False, above, lit, m.end("par")))
    return out


def classes(masked: str, lang: str) -> list[Member]:
    out = []
    for c in _CLASS[lang].finditer(masked):
        if lang == "python":
            ind, end = len(c["ind"]), masked.find("\n", c.end())
            end = len(masked) if end < 0 else end
            while 0 <= end < len(masked):
                nxt = masked.find("\n", end + 1)
                nxt = len(masked) if nxt < 0 else nxt
                seg = masked[end + 1 : nxt]
                if seg.strip() and len(seg) - len(seg.lstrip()) <= ind:
                    break
                end = nxt
        else:
            b = _BLOCK.match(masked, c.end())
            if not b:
                continue
            end = b.end()
        out.append(Member(c["name"], _block_start(masked, c.start()), c.start(), end, True))
    return out


def outermost(members: list[Member]) -> list[Member]:
    """The members that lie in no other member."""
    out, end = [], -1
    for m in sorted(members, key=lambda m: (m.sig, -m.end)):
        if m.sig >= end:
            out.append(m)
            end = m.end
    return out
