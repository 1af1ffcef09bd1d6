"""Symbols and raw edges of brace languages: a tokenizer, a splitter into declarations, and rules for each language.

There is no grammar behind it: a text is cut into tokens, brackets are paired, and a declaration goes from its first word to
its `;`, its block's end or, where a language has it so, the end of its line. Unfinished texts give what is readable.
Edges of kind references to types are found by the places where types stand in common code, not by a full grammar.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

# Names that are no targets of edges, by language.
GO_FUNCS = """make new len cap append copy close delete panic recover print println complex real imag clear min max"""
GO_TYPES = """bool byte rune int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 uintptr float32 float64 complex64 complex128 string error any comparable"""
C_TYPES = """void char short int long float double signed unsigned size_t ptrdiff_t ssize_t int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t bool FILE"""
C_FUNCS = """printf fprintf sprintf snprintf scanf fscanf sscanf malloc calloc realloc free memcpy memset memmove memcmp strlen strcmp strncmp strcpy strncpy
strcat strncat strstr strchr fopen fclose fread fwrite fgets fputs fseek ftell assert abort exit sizeof"""
CPP_TYPES = """void bool char short int long float double auto signed unsigned wchar_t char8_t char16_t char32_t size_t ptrdiff_t nullptr_t
int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t string string_view"""
CPP_FUNCS = """sizeof alignof decltype typeid static_cast dynamic_cast const_cast reinterpret_cast static_assert printf fprintf sprintf snprintf
malloc calloc realloc free memcpy memset memmove memcmp strlen strcmp strncmp strcpy strncpy"""
ENGINE_MACROS = """UCLASS USTRUCT UPROPERTY UFUNCTION UENUM UINTERFACE UMETA GENERATED_BODY GENERATED_UCLASS_BODY GENERATED_USTRUCT_BODY
DECLARE_DYNAMIC_MULTICAST_DELEGATE DECLARE_DELEGATE DECLARE_EVENT TEXT LOCTEXT NSLOCTEXT UE_LOG UE_CLOG check checkf ensure ensureMsgf IMPLEMENT_MODULE IMPLEMENT_GAME_MODULE"""
RUST_FUNCS = """println print eprintln eprint format write writeln panic todo unimplemented unreachable assert assert_eq assert_ne debug_assert debug_assert_eq debug_assert_ne
vec dbg cfg Some None Ok Err Box::new Rc::new Arc::new Vec::new String::new String::from HashMap::new HashSet::new Default::default"""
RUST_TYPES = """bool char i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize f32 f64 str String Vec Box Rc Arc Cell RefCell Option Result HashMap HashSet BTreeMap BTreeSet Self"""
JS_FUNCS = """console.log console.error console.warn console.info console.debug parseInt parseFloat isNaN isFinite encodeURI decodeURI encodeURIComponent decodeURIComponent
setTimeout setInterval clearTimeout clearInterval JSON.parse JSON.stringify Object.keys Object.values Object.entries Object.assign Array.isArray Array.from
Promise.resolve Promise.reject Promise.all Promise.race require alert confirm prompt fetch"""
JS_TYPES = """string number boolean void undefined null any unknown never object symbol bigint Array Object Function String Number Boolean Promise Map Set WeakMap WeakSet
Error TypeError RangeError SyntaxError Date RegExp Symbol BigInt Record Partial Required Readonly Pick Omit Exclude Extract NonNullable ReturnType InstanceType HTMLElement Event Node"""
KOTLIN_FUNCS = """println print readLine listOf mutableListOf arrayListOf mapOf mutableMapOf hashMapOf setOf mutableSetOf hashSetOf arrayOf intArrayOf longArrayOf doubleArrayOf
emptyList emptyMap emptySet require check error TODO run let also apply with lazy repeat buildString maxOf minOf"""
KOTLIN_TYPES = """Int Long Short Byte Float Double Boolean Char String Unit Nothing Any Array IntArray LongArray DoubleArray List MutableList ArrayList Map MutableMap HashMap
Set MutableSet HashSet Pair Triple Comparable Iterable Collection Sequence"""
SWIFT_FUNCS = """print debugPrint dump fatalError precondition preconditionFailure assert assertionFailure min max abs stride zip swap type
withUnsafePointer withUnsafeMutablePointer DispatchQueue.main.async"""
SWIFT_TYPES = """Int Int8 Int16 Int32 Int64 UInt UInt8 UInt16 UInt32 UInt64 Float Double Bool String Character Void Never Any AnyObject AnyClass Optional Array Dictionary Set
Error Result Codable Hashable Equatable Comparable Identifiable CustomStringConvertible Sequence Collection IteratorProtocol Self"""
STOP_FUNCS = {"go": GO_FUNCS, "c": C_FUNCS, "cpp": CPP_FUNCS + " " + ENGINE_MACROS, "rust": RUST_FUNCS, "javascript": JS_FUNCS, "typescript": JS_FUNCS, "kotlin": KOTLIN_FUNCS, "swift": SWIFT_FUNCS}
STOP_TYPES = {"go": GO_TYPES, "c": C_TYPES, "cpp": CPP_TYPES + " " + ENGINE_MACROS, "rust": RUST_TYPES, "javascript": JS_TYPES, "typescript": JS_TYPES, "kotlin": KOTLIN_TYPES, "swift": SWIFT_TYPES}
STOP_FUNCS, STOP_TYPES = ({k: frozenset(v.split()) for k, v in t.items()} for t in (STOP_FUNCS, STOP_TYPES))

LANGUAGES = ("go", "typescript", "javascript", "rust", "c", "cpp", "kotlin", "swift")
BY_LINES = {"go", "typescript", "javascript", "kotlin", "swift"}
#: Words of each language that no call's or type's name is.
SCRIPT = "if for while switch catch function return typeof new delete void await yield super import export class const let var else do case throw instanceof in of async extends implements this"
CPP = """if for while switch return sizeof catch new delete throw do else case default goto struct class enum union typedef namespace template typename using operator friend inline virtual
const static public private protected noexcept alignas explicit unsigned signed volatile extern final override this nullptr true false"""
KEYWORDS = {
    "go": "if for switch select func return defer go range map chan struct interface type var const import package case default else break continue goto fallthrough nil true false",
    "typescript": SCRIPT, "javascript": SCRIPT, "c": CPP, "cpp": CPP,
    "rust": "if while for match loop fn let mut ref return move impl where unsafe as in pub use mod struct enum trait type const static extern crate dyn else break continue self Self super",
    "kotlin": "if for while when catch return throw fun class object interface val var try else do in is as constructor init super this import package companion",
    "swift": "if for while switch guard catch return throw func class struct enum protocol extension let var init deinit case in is as self super repeat defer do else import inout",
}
KEYWORDS = {k: frozenset(v.split()) for k, v in KEYWORDS.items()}
#: A line that ends in one of these, or is followed by one of those, goes on.
OPEN_ENDS = frozenset(", ( [ = + - * / | & && || : . -> => < ? :: extends implements".split())
OPEN_STARTS = frozenset(". ?. : -> => && || ? extends implements where else throws".split())


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int
    line: int


def lexer(quotes: str) -> re.Pattern:
    return re.compile(
        rf"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<pp>^[ \t]*\#(?:\\\n|[^\n])*)|(?P<str>\"{{3}}.*?(?:\"{{3}}|\Z)|`[^`]*`|"(?:\\.|[^"\\\n])*"|{quotes})"""
        r"""|(?P<id>[^\W\d][\w$]*|\$[\w$]*)|(?P<num>\d[\w.]*)|(?P<nl>\n)|(?P<op>::|->|=>|\?\.|&&|\|\||:=|\.\.\.|[^\s])""",
        re.DOTALL | re.MULTILINE,
    )


ONE, MANY = lexer(r"'(?:\\[^']*|[^'\\\n])'"), lexer(r"'(?:\\.|[^'\\\n])*'")


class Item(NamedTuple):
    """A declaration: its tokens (last exclusive), those of them outside of brackets, and the comment before it."""

    first: int
    last: int
    head: list[int]
    doc: str


class Code:
    def __init__(self, path: str, text: str, lang: str):
        self.path, self.text, self.lang = path, text, lang
        self.tokens, self.close = [], {}
        line, at, opened = 1, 0, []
        for m in (MANY if lang in ("javascript", "typescript") else ONE).finditer(text):
            line += text.count("\n", at, m.start())
            at = m.start()
            kind = m.lastgroup
            if kind == "pp" and lang not in ("c", "cpp"):
                kind = "op"
            k = len(self.tokens)
            self.tokens.append(Token(kind, m[0], m.start(), m.end(), line))
            if kind == "op" and m[0] in "([{":
                opened.append(k)
            elif kind == "op" and m[0] in ")]}" and opened:
                self.close[opened.pop()] = k
        for k in opened:
            self.close[k] = len(self.tokens)
        self.symbols: list[dict] = []
        self.named: set[int] = set()  # tokens that name a symbol
        self.edges: list[tuple] = []
        if lang in RULES:
            self._walk(0, len(self.tokens), RULES[lang], "")

    def word(self, k: int) -> str:
        return self.tokens[k].text if 0 <= k < len(self.tokens) else ""

    def inside(self, k: int) -> str:
        """The text within the bracket at k."""
        end = self.close[k]
        return self.text[self.tokens[k].end : self.tokens[end].start if end < len(self.tokens) else len(self.text)]

    def _walk(self, first: int, last: int, rule, parent: str) -> None:
        for item in self.items(first, last):
            rule(self, item, [self.word(k) for k in item.head], parent)

    def body(self, item: Item) -> int | None:
        return next((k for k in item.head if self.word(k) == "{"), None)

    def members(self, item: Item, rule, parent: str) -> None:
        """Apply a rule to what is in an item's block."""
        if (k := self.body(item)) is not None:
            self._walk(k + 1, self.close[k], rule, parent)

    def items(self, first: int, last: int) -> Iterator[Item]:
        i, doc, hidden = first, "", 0
        while i < last:
            t = self.tokens[i]
            if t.kind == "pp":  # what conditions hold is no declaration of the file
                hidden += bool(re.match(r"\s*#\s*if", t.text)) - bool(re.match(r"\s*#\s*endif", t.text))
            if t.kind in ("nl", "comment", "pp") or t.text in (";", ","):
                doc = t.text if t.kind == "comment" else doc if t.kind == "nl" else ""
                i += 1
                continue
            j, head = i, []
            while j < last:
                u = self.tokens[j]
                if u.kind == "nl" and self.lang in BY_LINES and self._ends(head, j, last):
                    break
                if u.kind in ("nl", "comment", "pp"):
                    j += 1
                    continue
                if u.text == ";":
                    break
                head.append(j)
                j = self.close[j] + 1 if j in self.close else j + 1
                if u.text == "{" and self._complete(head, j, last):
                    break
            if not hidden:
                yield Item(i, min(j, last), head, doc)
            i, doc = max(j, i + 1), ""

    def _ends(self, head: list[int], j: int, last: int) -> bool:
        if not head or self.word(head[-1]) in OPEN_ENDS and head[-1] not in self.close:
            return False
        after = next((t for t in self.tokens[j:last] if t.kind not in ("nl", "comment")), None)
        return self.lang == "go" or after is None or not (after.text in OPEN_STARTS or after.text == "{" and self.word(head[-1]) != "}")

    def _complete(self, head: list[int], j: int, last: int) -> bool:
        """Whether a declaration ends with the block before j."""
        words = [self.word(k) for k in head]
        if self.lang in ("c", "cpp"):
            return "=" not in words and ("(" in words[: words.index("{")] or not {"struct", "class", "enum", "union", "typedef"} & set(words[: words.index("{")]))
        if self.lang == "rust":
            return "=" not in words and words[0] != "use"
        after = self.tokens[j] if j < last else None
        return after is None or after.kind in ("nl", "comment") or after.text in "};" or "=" not in words

    def add(self, item: Item, name: int | str, kind: str, parent: str = "", sep: str = ".", qualified: str | None = None, first: int | None = None, last: int | None = None) -> str:
        if isinstance(name, int):
            self.named.add(name)
            name = self.word(name)
        a = item.first if first is None else first
        b = min(item.last if last is None else last, len(self.tokens))
        b = next(k for k in range(b - 1, a - 1, -1) if self.tokens[k].kind not in ("nl", "comment", "pp"))
        content = self.text[self.tokens[a].start : self.tokens[b].end]
        doc = item.doc if re.match(DOCS.get(self.lang, "/"), item.doc) else ""
        start = self.tokens[a].line
        self.symbols.append({
            "name": name, "qualified": qualified or (f"{parent}{sep}{name}" if parent else name), "kind": kind, "line_start": start, "line_end": start + content.count("\n"),
            "signature": content.split("\n", 1)[0].strip(), "doc_comment": doc, "parent_class": parent, "content": content,
        })
        return name

    def enclosing(self, line: int) -> str:
        """The narrowest symbol around a line, the first of equals."""
        around = [(s["line_end"] - s["line_start"], k) for k, s in enumerate(self.symbols) if s["line_start"] <= line <= s["line_end"]]
        return self.symbols[min(around)[1]]["qualified"] if around else ""

    # edges

    def relationships(self) -> list[tuple]:
        """(source, target, kind, line) in the order of the text."""
        code = [k for k, t in enumerate(self.tokens) if t.kind not in ("nl", "comment")]
        for n, k in enumerate(code):
            t = self.tokens[k]
            near = lambda step: self.word(code[n + step]) if 0 <= n + step < len(code) else ""  # noqa: B023, E731
            if t.kind == "pp" and (m := re.match(r"\s*#\s*include\s*([<\"][^>\"\n]*[>\"])", t.text)):
                self.edges.append((self.path, m[1].strip('"<>'), "references", t.line))
            elif t.kind == "id" and t.text == "import" and self.lang in ("typescript", "javascript") and near(1) != "(":
                source = next((self.tokens[x].text for x in code[n + 1 : n + 60] if self.tokens[x].kind == "str"), "")
                if source:
                    self.edges.append((self.path, source.strip("\"'`"), "references", t.line))
            elif t.kind == "id" and t.text == "import" and self.lang in ("kotlin", "swift"):
                m = re.match(r"import\s+(?:(?:class|struct|enum|protocol|func)\s+)?([\w.]+)", self.text[t.start :])
                if m:
                    self.edges.append((self.path, m[1].rstrip("."), "references", t.line))
            elif t.kind == "id" and t.text == "use" and self.lang == "rust":
                m = re.match(r"use\s+((?:\w+::)*\w+(?:::\*)?)", self.text[t.start :])
                if m:
                    self.edges.append((self.path, m[1], "references", t.line))
            elif t.kind == "id" and self.lang in RULES and t.text not in KEYWORDS[self.lang] and k not in self.named:
                self._call_or_type(code, n, near)
        return sorted(self.edges, key=lambda e: e[3])

    def _call_or_type(self, code: list[int], n: int, near) -> None:
        t, lang = self.tokens[code[n]], self.lang
        before, after = near(-1), near(1)
        if lang == "cpp" and after == "<" and (m := re.match(r"\w+<[\w:, *&]*>\(", self.text[t.start :])):
            after = "("
        if after == "(" and before not in ("new", "func", "fn", "fun", "function", "class", "import") and not (lang == "cpp" and before == ":" and near(-2) == ")") and not (lang == "rust" and before == "!"):
            name = t.text
            if lang in ("go", "typescript", "javascript", "kotlin", "swift") and before in (".", "?."):
                owner = near(-2)
                if re.match(r"[^\W\d]", owner) and near(-3) not in (".", "?.") and owner not in ("this", "super"):
                    name = f"{owner}.{name}"
            elif lang in ("rust", "cpp") and before == "::":
                back = n
                while back >= 2 and self.word(code[back - 1]) == "::":
                    back -= 2
                name = "".join(self.word(code[x]) for x in range(back, n + 1))
            elif lang in ("c", "cpp") and self._declares(code, n, before):
                return
            source = self.enclosing(t.line)
            if source and name not in STOP_FUNCS[lang]:
                self.edges.append((source, name, "calls", t.line))
        elif t.text not in STOP_TYPES[lang] and self._is_type(code, n, before, after, near):
            source = self.enclosing(t.line)
            if source and source != t.text:
                self.edges.append((source, t.text, "references", t.line))

    def _declares(self, code: list[int], n: int, before: str) -> bool:
        """Whether name( declares rather than calls: a type stands before it and no block holds it."""
        return bool(re.match(r"[^\W\d]", before)) and before not in ("return", "else", "case", "throw", "co_return")

    def _is_type(self, code: list[int], n: int, before: str, after: str, near) -> bool:
        t, lang = self.tokens[code[n]], self.lang
        is_name = lambda w: bool(re.match(r"[^\W\d]", w)) and w not in KEYWORDS[lang]
        if lang in ("c", "cpp"):
            starts = before in ("", ";", "{", "}", "(", ",", "const", "static", "extern", "inline", "virtual", ":", ">", "typedef", "<") or before.lstrip().startswith("#")
            return starts and (is_name(after) or after in ("*", "&") and is_name(near(2)) or before == "<" and after == ">")
        if lang == "rust":
            return t.text[:1].isupper() and after not in ("(", "::", "!") and before not in ("struct", "enum", "trait", "type", "fn", "use", "mod", "::", "impl", "for") and not (before in ("{", ",", "") and after in (",", "}", "="))
        if lang in ("kotlin", "swift"):
            return t.text[:1].isupper() and before in (":", "<", "as", "is", "->", "?") and after != "."
        if lang == "typescript":
            return t.text[:1].isupper() and before in (":", "<", "|", "&", "as", "is", "keyof") and after != "."
        if lang == "go":
            owner = n - 2 if before == "." else n
            first, before = self.tokens[code[owner]], self.word(code[owner - 1]) if owner else ""
            if owner and before in ("*", "&", "]") and self.tokens[code[owner - 1]].end == first.start:
                return before != "&" or after == "{"
            if after == "{" and self.tokens[code[n + 1]].start == t.end and before not in ("struct", "interface"):
                return True
            prev = self.tokens[code[owner - 1]] if owner else None
            return prev is not None and prev.line == first.line and after not in (":=", "=", "(", ":", ".") and (prev.kind == "id" and prev.text not in KEYWORDS[lang] and owner - 1 not in self.named or prev.text == ")" and after in ("{", ","))
        return False

    def inherits(self, item: Item, name: str, bases: list[str]) -> None:
        line = self.tokens[item.head[0]].line
        self.edges += [(name, b, "inherits", line) for b in bases if b and b not in STOP_TYPES.get(self.lang, ())]


#: Where only comments of one form are a symbol's documentation.
DOCS = {"rust": r"/\*", "kotlin": r"(?!)", "swift": "//"}


def after(words: list[str], *wanted: str) -> int:
    """The place after the first of some words; 0 if there is none."""
    return next((k + 1 for k, w in enumerate(words) if w in wanted), 0)


def go_rule(code: Code, item: Item, words: list[str], parent: str) -> None:
    if words[0] == "func" and words[1:2] == ["("] and len(words) > 2:
        receiver = code.inside(item.head[1]).split()
        owner = receiver[-1].removeprefix("*") if receiver else ""
        code.add(item, item.head[2], "method", owner)
    elif words[0] == "func" and len(words) > 1:
        code.add(item, item.head[1], "function")
    elif words[0] == "type" and len(words) > 1:
        specs = code.items(item.head[1] + 1, code.close[item.head[1]]) if words[1] == "(" else [item._replace(head=item.head[1:])]
        for spec in specs:
            rest = [code.word(k) for k in spec.head[1:]]
            if rest[:1] == ["["] and len(rest) > 1 and code.tokens[spec.head[1]].start == code.tokens[spec.head[0]].end:
                rest = rest[1:]
                rest = rest[1:] if rest[0] == "]" else rest
            if not rest or rest[0] == "=":
                continue
            kind = {"struct": "struct", "interface": "class"}.get(rest[0], "typedef")
            name = code.add(item, spec.head[0], kind)
            block = next((k for k in spec.head if code.word(k) == "{"), None)
            if kind == "struct" and block is not None:
                for f in code.items(block + 1, code.close[block]):
                    words = [code.word(k) for k in f.head if code.tokens[k].kind != "str"]
                    if len(words) == 1 or words[0] == "*" and len(words) in (2, 4) or len(words) == 3 and words[1] == ".":
                        code.inherits(f, name, ["".join(words).removeprefix("*")])
            elif kind == "class" and block is not None:
                code.named.update(f.head[0] for f in code.items(block + 1, code.close[block]))


def script_rule(code: Code, item: Item, words: list[str], parent: str) -> None:
    k = 0
    while k < len(words) and words[k] in ("export", "default", "async"):
        k += 1
    k -= words[k - 1 : k] == ["async"]
    head, rest = item.head[k:], words[k:]
    if not rest:
        return
    typed, first = code.lang == "typescript", head[0]
    doc = item if k == 0 else item._replace(doc="")
    at = after(rest[:2], "function")
    if at and rest[at : at + 1] not in ([], ["*"], ["("]):
        code.add(doc, head[at], "function", first=first)
    elif rest[0] == "class" and len(rest) > 1 and rest[1] != "{":
        name = code.add(doc, head[1], "class", first=first)
        bases, clause = [], False
        for w in rest[2:]:
            if w == "{":
                break
            clause = clause or w in ("extends", "implements")
            if clause and re.match(r"[^\W\d]|\.", w) and w not in ("extends", "implements"):
                bases.append(w)
            elif w == "<":
                clause = False
            elif w in (",", ">"):
                clause = w == "," or clause
        code.inherits(item, name, [b for b in ".".join(" ".join(bases).split(" . ")).split() if b])
        code.members(item, member_rule, name)
    elif rest[0] == "interface" and typed and len(rest) > 1:
        code.add(doc, head[1], "struct", first=first)
    elif (rest[0] == "enum" or rest[:2] == ["const", "enum"]) and typed:
        code.add(doc, head[after(rest, "enum")], "enum", first=first)
    elif rest[0] in ("const", "let") or rest[0] == "var" and not typed:
        eq = after(rest, "=")
        value = rest[eq:]
        arrow = value[1:] if value[:1] == ["async"] else value
        if eq and arrow and (arrow[1:2] == ["=>"] or arrow[0] == "(" and "=>" in arrow[1:]):
            code.add(doc, head[1], "function", first=first)


def member_rule(code: Code, item: Item, words: list[str], parent: str) -> None:
    k = 0
    while k + 1 < len(words) and words[k] in ("static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "*", "#") and words[k + 1] != "(":
        k += 1
    if words[k + 1 : k + 2] == ["("] and "{" in words[k + 2 :] and "=" not in words[: words.index("{")]:
        code.add(item, item.head[k], "method", parent)


def rust_rule(code: Code, item: Item, words: list[str], parent: str) -> None:
    k = 0
    while k < len(words) and (words[k] in ("pub", "async", "unsafe", "const", "extern", "default", "(") or words[k] == "#" or words[k] == "[" or words[k].startswith('"')):
        k += 1
    if k + 1 >= len(words):
        return
    first = next((x for x in range(len(words)) if words[x] not in ("#", "[")), 0)
    item = item._replace(first=item.head[first], doc=item.doc if first == 0 else "")
    head, rest = item.head[k:], words[k:]
    if rest[0] == "fn" and ("{" in rest or not parent):
        code.add(item, head[1], "method" if parent else "function", parent, "::")
    elif rest[0] in ("struct", "enum") and not parent:
        code.add(item, head[1], rest[0])
    elif rest[0] == "trait" and not parent:
        code.members(item, rust_rule, code.add(item, head[1], "class"))
    elif rest[0] == "impl" and not parent and (block := code.body(item)) is not None:
        text = code.text[code.tokens[head[0]].end : code.tokens[block].start].split(" where ")[0].strip()
        if text.startswith("<"):
            depth = end = 0
            for end, c in enumerate(text, 1):
                depth += (c == "<") - (c == ">")
                if depth == 0:
                    break
            text = text[end:].strip()
        trait, _, kind = text.rpartition(" for ")
        if trait:
            code.inherits(item, kind.split("<")[0].strip(), [trait.split("<")[0].strip()])
        code.members(item, rust_rule, kind.strip())


def c_rule(code: Code, item: Item, words: list[str], parent: str) -> None:
    cut = words.index("{") if "{" in words else len(words)
    if code.lang == "cpp":
        while words[1:2] == [":"] and words[0] in ("public", "private", "protected"):
            item = item._replace(first=item.head[2] if len(item.head) > 2 else item.first, head=item.head[2:])
            words, cut = words[2:], cut - 2
            if not words:
                return
        if words[0] == "template":
            depth = 0
            for end, w in enumerate(words[1:], 2):
                depth += (w == "<") - (w == ">")
                if depth == 0:
                    break
            rest = item._replace(first=item.head[end] if end < len(item.head) else item.first, head=item.head[end:], doc="")
            return c_rule(code, rest, words[end:], parent) if words[end:] else None
        if words[0] == "namespace" or words[:2] == ["inline", "namespace"]:
            return code.members(item, c_rule, parent)
    if words[0] in ("typedef", "using", "extern", "friend") and "(" not in words[:cut]:
        return None
    call = words[:cut].index("(") if "(" in words[:cut] else 0
    defined = "{" in words or code.lang == "cpp" and words[-2:] in (["=", "default"], ["=", "delete"])
    if call and defined and "=" not in words[:call] and words[0] != "typedef":
        k = call - 1
        while k >= 2 and words[k - 1] == "::":
            k -= 2
        k -= k >= 1 and words[k - 1] == "~"
        name = "".join(words[k:call])
        code.named.update(item.head[k:call])
        code.add(item, name, "method" if parent else "function", parent, "::")
    elif not parent:
        for k, w in enumerate(words[:cut]):
            kinds = ("struct", "enum", "class") if code.lang == "cpp" else ("struct", "enum")
            if w in kinds and k + 1 < len(words):
                at = k + 1 + (words[k + 1] in ("class", "struct"))
                while at + 1 < cut and re.match(r"[^\W\d]", words[at + 1]) and words[at + 1] not in ("final",) and words[at].isupper():
                    at += 1  # an export macro before the name
                if not re.match(r"[^\W\d]", words[at]):
                    return None
                last = code.close[code.body(item)] + 1 if "{" in words else item.head[at] + 1
                name = code.add(item, item.head[at], w, first=item.head[k], last=last)
                if ":" in words[at:cut] and w != "enum":
                    text = code.text[code.tokens[item.head[at + words[at:cut].index(":")]].end : code.tokens[item.head[cut]].start if cut < len(words) else None]
                    code.inherits(item, name, [re.sub(r"\b(public|private|protected|virtual)\b", "", b).split("<")[0].strip() for b in text.split(",")])
                if w == "class":
                    code.members(item, c_rule, name)
                return None
    return None


MODIFIERS = frozenset("public private protected internal open override final abstract data sealed inner inline suspend tailrec operator infix external const lateinit annotation value expect actual fileprivate static mutating nonmutating required convenience dynamic indirect lazy weak unowned vararg noinline crossinline".split())


def mobile_rule(code: Code, item: Item, words: list[str], parent: str) -> None:
    """Kotlin and Swift: what they declare has the same outline."""
    k = 0
    while k < len(words) and (words[k] in MODIFIERS and not (words[k] in ("data", "value", "operator") and k + 1 < len(words) and words[k + 1] in ("=", "(")) or words[k] == "@" or k and words[k - 1] == "@" or words[k] == "(" and k > 1 and words[k - 2] == "@"):
        k += 1
    head, rest = item.head[k:], words[k:]
    if len(rest) < 2:
        return
    swift = code.lang == "swift"
    companion = rest[:2] == ["companion", "object"]
    outer = parent.removesuffix(".Companion") if not swift else parent
    if rest[0] in ("fun", "func"):
        at = 1
        if rest[1] == "<":
            at = after(rest, ">")
        call = rest.index("(", at) if "(" in rest[at:] else 0
        if call:
            receiver = "".join(rest[at : call - 1]).removesuffix(".") if not swift else ""
            code.add(item, head[call - 1], "method" if parent else "function", outer, qualified=f"{parent or receiver}.{rest[call - 1]}" if parent or receiver else None)
    elif rest[0] in ("class", "interface", "object", "struct", "enum", "protocol", "extension", "actor") or rest[:2] == ["fun", "interface"]:
        at = 1 + (rest[1] in ("class", "interface"))
        kind = "enum" if rest[0] == "enum" else "struct" if rest[0] == "struct" else "class"
        name = rest[at]
        if rest[0] == "extension":
            name = code.text[code.tokens[head[1]].start : code.tokens[code.body(item) or head[1]].start].split(":")[0].split(" where ")[0].strip()
        else:
            code.add(item, head[at], kind, outer)
        if rest[0] == "protocol":
            code.members(item, mobile_rule, name)
        else:
            code.members(item, mobile_rule, name)
        cut = rest.index("{") if "{" in rest else len(rest)
        if ":" in rest[:cut]:
            code.named.update(head[rest.index(":") : cut])
            text = code.text[code.tokens[head[rest.index(":")]].end : code.tokens[head[cut]].start if cut < len(rest) else code.tokens[item.last - 1].end]
            code.inherits(item, name, [re.split(r"[<(\s]", b.strip())[0] for b in re.sub(r"\([^()]*\)|<[^<>]*>", "", text).split(",")])
    elif companion:
        own = f"{parent}.{rest[2] if len(rest) > 2 and re.match(r'[^\W\d]', rest[2]) else 'Companion'}"
        code.members(item, mobile_rule, own if own.endswith(".Companion") else own)
    elif rest[0] in ("val", "var", "let") and re.match(r"[^\W\d]", rest[1]) and (swift or not rest[1].startswith("_")):
        code.add(item, head[1], "function", outer, qualified=f"{parent}.{rest[1]}" if parent else None)


RULES = {"go": go_rule, "typescript": script_rule, "javascript": script_rule, "rust": rust_rule, "c": c_rule, "cpp": c_rule, "kotlin": mobile_rule, "swift": mobile_rule}
