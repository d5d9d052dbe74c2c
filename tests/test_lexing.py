"""Structure of sources by tokens: what the lexer's states keep out, and declarations by language."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.functions import lexing
from codeloom.operators import chunking


def shown(code, language):
    return " ".join(f"{k}:{n}:{line}" for k, n, line in lexing.outline(code, language)[1])


CASES = [
    ("c", "int add(int a, int b) {\n  return a;\n}\nstruct point *make(int x)\n{\n  if (x) { y(); }\n}\nint proto(int x);\nint t[] = {1, 2};\ntypedef struct { int a; } pair;\n", "function:add:1 function:make:4 function:proto:8 type:pair:10", [1, 4, 8, 9, 10]),
    ("cpp", "template <typename T> class Box : public B<T> {\n  Box() : x_(1) { init(); }\n  ~Box() {}\n  class In { void go(); };\n};\nint Box<int>::size() const noexcept { return 1; }\nauto raw = R\"x( } { )x\";\nenum class Kind { A };\n", "class:Box:1 method:Box:2 method:~Box:3 class:In:4 method:go:4 function:size:6 enum:Kind:8", [1, 6, 7, 8]),
    ("java", "class A {\n  Map<String, List<T>> m = new HashMap<>();\n  @Override public List<T> find(int n) throws E { return x.map(a -> { return a; }); }\n  abstract int area();\n  String s = \"\"\"\n    class No { } \"\"\";\n  enum Size { S }\n}\n", "class:A:1 method:find:3 method:area:4 enum:Size:7", [1]),
    ("csharp", "namespace A.B {\n  public class S : I {\n    public int Count { get; set; }\n    public async Task<int> Find<T>(string q) where T : class { var s = @\"a \"\" { \"; }\n    public int Two() => 2;\n  }\n}\n", "module:B:1 class:S:2 method:Find:4 method:Two:5", [1]),
    ("javascript", "const t = `function no() { ${x.map(i => `}${i}`)}`;\nconst re = /[/{]\\/{2}/g.test(x);\n// class Fake {\nclass G {\n  get size() { return 1 / 2 / 3 }\n  handle = (e) => { go(); }\n}\nmodule.exports.h = function () {\n}\nitems\n  .map(x => x)\nfunction* gen(a = {}) {\n}\n", "class:G:4 method:size:5 method:handle:6 function:h:8 function:gen:12", [1, 2, 4, 8, 10, 12]),
    ("typescript", "@Component({ a: '{' })\nexport class Cmp {\n  greet(a: string): Map<string, number> { return 1; }\n  abstract go(): void;\n}\ntype Fn = (a: number) => void\nconst h: H = async (r): Promise<void> => { }\n", "class:Cmp:2 method:greet:3 method:go:4 type:Fn:6 function:h:7", [1, 6, 7]),
    ("go", "package a\ntype (\n\tA struct { y int }\n\tB int\n)\nfunc (s *S) Run(x int) (err error) {\n\ty := `raw } {`\n}\nfunc Map[T any](x []T) []T { return x }\nvar x = map[string]int{\n\t\"a\": 1,\n}\n", "type:A:3 type:B:4 function:Run:6 function:Map:9", [1, 2, 6, 9, 10]),
    ("rust", "/* outer /* inner { */ } */\n#[derive(Debug)]\npub struct P<'a> { x: &'a str }\nimpl<'a> D for P<'a> {\n  fn fmt(&self) -> R { m!(\"{}\") }\n}\ntrait S { fn area(&self) -> f64; }\npub async fn run<T: Into<String>>(x: T) -> R where T: C { let s = r#\"fn no() { \"q\" }\"#; let c = '{'; }\n", "struct:P:3 method:fmt:5 interface:S:7 method:area:7 function:run:8", [2, 4, 7, 8]),
    ("ruby", "class B < A\n  def self.one(a) = new(a)\n  def add(x)\n    return if x\n    y = if a then b else c end\n    while true do break end\n    @i.each do |z| puts \"end\" unless z =~ /end\\/{/ end\n  end\nend\n=begin\ndef nope\n=end\ntext = <<~EOS\n  def fake\nEOS\ndef top\n  1\nend\n", "class:B:1 method:one:2 method:add:3 function:top:16", [1, 13, 16]),
    ("lua", "--[[ function no()\nend ]]\nlocal function helper(a)\n  if a then return 1 end\n  for i = 1, 3 do p(i) end\n  repeat x = 1 until x\nend\nfunction M.run(b)\n  local s = [[ end ]]\nend\nM.later = function(c)\nend\n", "function:helper:3 function:run:8 function:later:11", [3, 8, 11]),
    ("python", "print 'old'\nclass A(object):\n    \"\"\"def nope(): x\"\"\"\n    def b(self, x=(1,\n            2)):\n        def inner(): pass\n@dec\ndef e(): pass\n", "class:A:2 method:b:4 function:inner:6 function:e:8", [1, 2, 7]),
    ("sql", "/* CREATE VIEW no */\nCREATE TABLE s.items (a text default ';');\ncreate function f(a int) RETURNS int AS $$ BEGIN; END; $$;\nINSERT INTO x VALUES (1)", "table:items:2 function:f:3", [2, 3, 4]),
    ("kotlin", "class S(val a: Int) : B(a) {\n    fun sell(x: Int): Int = x + 1\n    companion object { fun of() = S(1) }\n}\nfun String.shout() = \"${this} {\"\nobject One { }\n", "class:S:1 method:sell:2 method:of:3 function:shout:5 class:One:6", [1, 5, 6]),
    ("bash", "tag() {\n  echo \"${1#a}\" # }\n}\nfunction other { cat <<EOF\nfake() {\nEOF\n}\n", "function:tag:1 function:other:4", [1, 4]),
    ("elixir", "defmodule A.B do\n  def add(a) when a > 1 do\n    if a do b else c end\n  end\n  defp one(x), do: x\nend\n", "module:B:1 function:add:2 function:one:5", [1]),
    ("swift", "extension A: B {\n  func go(x: Int) -> Int? { return x }\n}\nstruct V: W { var b: some W { T(\"{\") } }\n", "method:go:2 struct:V:4", [1, 4]),
    ("php", "<?php\n# class Ghost {\nclass S extends B {\n  public function sell($a) { return \"{ $a\"; }\n}\n$f = function ($x) { };\n", "class:S:3 method:sell:4 function:f:6", [3, 6]),
]


@pytest.mark.parametrize(("language", "code", "symbols", "starts"), CASES, ids=[c[0] for c in CASES])
def test_structure(language, code, symbols, starts):
    assert shown(code, language) == symbols
    assert lexing.outline(code, language)[0] == starts


SIGNS = st.lists(st.sampled_from(["{", "}", "(", ")", "[", "]", "`", "${", '"', "'", '"""', "//", "/*", "*/", "#", "\n", " ", "\\", ";", ",", "=", "=>", "<", ">", ":", "@", "class", "function", "def", "end", "do", "if", "x", "1", "/", "<<A", "A", "type", "template", "é", "r#", "$$", "--[["]), max_size=40).map("".join)


@settings(max_examples=150, deadline=None)
@given(SIGNS)
def test_tokens_lose_nothing(code):
    for language in lexing.LANGUAGES:
        kept = [t for _, t, _, _ in lexing.tokens(code, language)]
        assert "".join(kept).replace("\\\n", "").replace(" ", "") == code.replace("\\\n", "").replace(" ", "") or "\\" in code
        starts, symbols, _ = lexing.outline(code, language)
        assert starts == sorted(starts) and all(1 <= s <= code.count("\n") + 1 for s in starts)
        assert len({(n, at) for _, n, at in symbols}) == len(symbols)


@settings(max_examples=60, deadline=None)
@given(SIGNS)
def test_chunks_cover_every_word(code):
    for language in ("javascript", "c", "ruby", "sql", "python", "rust"):
        joined = "".join(text for _, _, text, _ in chunking.chunk_file(code, language))
        assert joined.count("x") == code.count("x")


def test_long_files_take_time_in_proportion():
    for language, code in (("javascript", "var a = [" + "{ b: function () { return 1 }, c: [1, 2] }, " * 20_000 + "]"), ("c", "int t[] = {" + "{1, 2}, " * 60_000 + "};"), ("ruby", "x = <<A\n" * 4_000), ("java", "@A(" * 20_000)):
        began = time.time()
        lexing.outline(code, language)
        assert time.time() - began < 20


def test_parts_keep_remarks_and_small_neighbours():
    code = "import a from './b'\n\n// says hello, in a line of its own\nexport function hello(name) {\n  return `Hello ${name}`\n}\n\n/* of two\n   lines */\nexport class Bye {\n  say() { return 'bye, and that is all of it' }\n}\n"
    got = [(a, b, [s[1] for s in symbols]) for a, b, _, symbols in chunking.chunk_file(code, "javascript")]
    assert got == [(1, 7, ["hello"]), (8, 13, ["Bye", "say"])]
    assert [c[:2] for c in chunking.chunk_file("// nothing but a remark\n", "go")] == [(1, 2)]
    assert chunking.chunk_file("a: 1\n", "yaml")[0][:2] == (1, 2) and chunking.chunk_file("a", None) == []


def test_python_is_parsed_once_for_parts_and_symbols(monkeypatch):
    import ast

    from codeloom.operators import chunking

    parsed, parse = [], ast.parse
    monkeypatch.setattr(ast, "parse", lambda code: parsed.append(code) or parse(code))
    code = "import os\nx = [a for a in (lambda: 1, 2)]\n\n\nclass A:\n    def f(self):\n        try:\n            pass\n        except ValueError:\n            def g(): pass\n        match 1:\n            case 1:\n                class B: pass\n"
    found = chunking.structure(code, "python")
    assert parsed == [code]
    assert found[:2] == ([1, 2, 5], [("class", "A", 5), ("method", "f", 6), ("function", "g", 10), ("class", "B", 13)])


def test_spaces_are_stepped_over(monkeypatch):
    """The pattern is tried once for each token, not for the spaces between them too."""
    real, tried = lexing._pattern("go"), []

    class Counting:
        def match(self, code, at):
            tried.append(at)
            return real.match(code, at)

    monkeypatch.setattr(lexing, "_pattern", lambda language: Counting())
    read = list(lexing.tokens("func a ( b int )   {\n  return   b\n}\n", "go"))
    assert [t[1] for t in read] == ["func", "a", "(", "b", "int", ")", "{", "\n", "return", "b", "\n", "}", "\n"]
    assert len(tried) == len(read) and read[8][3] == 2
