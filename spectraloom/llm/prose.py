"""The prose of a LaTeX text: without preamble, formulas, comments, disabled passages and bibliography."""

from __future__ import annotations

import re
import unicodedata

_COMMENT = re.compile(r"(?<!\\)%[^\n]*")
_DROPPED = re.compile(
    r"\\iffalse\b.*?(?:\\fi\b|\Z)"
    r"|\\begin\{(comment|equation|align|alignat|gather|multline|eqnarray|displaymath|math|tabular|array|verbatim|lstlisting|thebibliography)(\*?)\}.*?(?:\\end\{\1\2\}|\Z)"
    r"|\$\$.*?(?:\$\$|\Z)|\\\[.*?(?:\\\]|\Z)|\\\(.*?\\\)|\$(?:[^$\\]|\\.)*\$",
    re.S,
)
_COMMANDS = re.compile(
    r"\\(?:[cC]ite\w*|ref|eqref|autoref|pageref|label|includegraphics|bibliography\w*|input|include|subfile|vspace|hspace|todo|url|begin|end|textcolor|color)\*?(?:\[[^\]\n]*\])*\{[^}\n]*\}"
    r"|\\[a-zA-Z@]+\*?|\[[a-z]+\d{4}[a-z]?\]"
)
_ACCENT = re.compile(r"\\['`^\"~=.](?:\{([a-zA-Z])\}|([a-zA-Z]))|\\c\{([a-zA-Z])\}")
_MACRO = re.compile(r"\\(?:(?:re)?newcommand\*?|providecommand\*?|def)\s*\{?\\([a-zA-Z]+)\}?\s*\{([a-zA-Z][a-zA-Z \-]*?)(?:\\xspace)?\}")
_SECTION = re.compile(r"\\(?:sub)*section\*?\{|\\chapter\*?\{|\\begin\{abstract\}|\\end\{abstract\}")
_WORD = re.compile(r"[^\W\d_]{3,}")


def sections(text: str | None) -> list[list[str]]:
    """Words (three letters or more, lower case, without accents) of each section with any.

    The abstract and what stands before the first heading are sections of their own.
    Parts that do not end, as in a file cut off, reach to the end of the text. Macros
    of the preamble that stand for plain words are written out. Null and empty texts
    have no sections.
    """
    if not text:
        return []
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    start = text.find("\\begin{document}")
    head, body = (text[:start], text[start + 16 :]) if start >= 0 else ("", text)
    stop = body.find("\\end{document}")
    if stop >= 0:
        body = body[:stop]
    if "%" in body:
        body = _COMMENT.sub("", body)
    body = _DROPPED.sub(" ", body)
    for name, words in _MACRO.findall(head):
        if f"\\{name}" in body:
            body = re.sub(rf"\\{name}(?![a-zA-Z])", words, body)
    if "\\" in body:
        body = _ACCENT.sub(lambda m: m[1] or m[2] or m[3], body)
    out = []
    for part in _SECTION.split(body):
        part = _COMMANDS.sub(" ", part).lower()
        if not part.isascii():
            part = "".join(c for c in unicodedata.normalize("NFKD", part) if not unicodedata.combining(c))
        words = _WORD.findall(part)
        if words:
            out.append(words)
    return out
