"""Character classes and lists whose members are fixed values.

The class texts go inside ``[...]`` and are written in escapes that Java and
RE2 both read.
"""

# white space as browsers trim and split it
WHITE = (
    r"\t\n\x{0B}\x{0C}\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
WHITE_CHARS = "\t\n\x0b\x0c\r \xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　﻿"

# characters that stand for nothing: white space, controls, format and private
# use characters, the replacement character, and what is ignored by default
UNREADABLE = (
    r"\p{Z}\p{Cc}\p{Cf}\p{Co}\x{FFFD}\x{034F}\x{115F}-\x{1160}\x{17B4}-\x{17B5}\x{180B}-\x{180F}\x{2065}\x{3164}"
    r"\x{FE00}-\x{FE0F}\x{FFA0}\x{FFF0}-\x{FFF8}\x{E0000}-\x{E0FFF}"
)

# scripts drawn two columns wide
WIDE = (
    r"\x{1100}-\x{115F}\x{2E80}-\x{303E}\x{3041}-\x{33FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{A000}-\x{A4CF}"
    r"\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}\x{20000}-\x{3FFFD}"
)

# The same classes for Java, which tries the members of a union in turn: a plain
# range in front settles most characters at once, and keeps a class that holds
# none of them from trying its own.
J_WHITE = rf"[^!-~]&&[{WHITE}]"
J_NOT_WHITE = rf"!-~[^{WHITE}]"
J_READABLE = rf"!-~[^{UNREADABLE}]"
J_WIDE = rf"[^\x{{0}}-\x{{10FF}}]&&[{WIDE}]"
J_NOT_WIDE = rf"\x{{0}}-\x{{10FF}}[^{WIDE}]"

# fence labels that open in a side panel
RENDERABLE = "html svg docx xlsx pptx".split()
CODE = """
javascript js jsx mjs cjs typescript ts tsx python py rust rs go golang java kotlin kt swift objc objective-c
objectivec c h cpp c++ cc hpp cs csharp c# fsharp f# vb vbnet vb.net basic pascal delphi php ruby rb perl lua r
scala haskell hs elixir erlang clojure dart zig nim ocaml julia matlab octave fortran cobol ada groovy solidity
verilog vhdl asm assembly nasm wasm wat lisp scheme racket elm purescript crystal tcl awk sh bash zsh shell fish
powershell ps1 bat cmd sql tsql plsql graphql regex proto protobuf prisma css scss sass less stylus vue svelte
astro erb ejs jinja jinja2 handlebars hbs json jsonc json5 yaml yml toml ini xml xsl xslt latex tex bibtex mermaid
dot graphviz puml plantuml dockerfile makefile cmake nix terraform hcl gradle diff patch
""".split()
ARTIFACT_LABELS = RENDERABLE + CODE

# what an artifact is called when nothing names it
LABEL_NAMES = {
    "html": "Web page", "svg": "Vector graphic", "js": "JavaScript", "javascript": "JavaScript", "ts": "TypeScript",
    "typescript": "TypeScript", "python": "Python", "py": "Python", "rust": "Rust", "go": "Go", "bash": "Shell",
    "sh": "Shell", "css": "CSS", "json": "JSON", "sql": "SQL", "yaml": "YAML",
}

EXTRACTABLE = ["pdf", "docx", "odt", "pptx", "xlsx"]
LEGACY = ["doc", "rtf", "pages", "key", "numbers", "xls", "ppt"]
TEMPLATE = ["dotx", "potx"]
MACRO_TEMPLATE = ["dotm", "potm"]
