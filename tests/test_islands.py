import random

import pytest

from quillspark.sources import code, islands


def _told(text, language):
    found = islands.islands(text, language)
    return [s[:3] for s in found.symbols], [(k, text[a:b]) for k, a, b in found.imports], len(found.errors)


GO = """package main

import (
	"fmt"
	str "strings" // func inComment() {}
)

/* func alsoComment() {} type X int */
const text = `func inRaw() { import "no" }`

type (
	Server struct {
		name string
		log  func(string)
	}
	Alias = Server
)

type Runner interface {
	Run(ctx Context, args ...string) error
}

func (s *Server) Run(a, b int, c string) (n int, err error) {
	go func() { fmt.Println("func inString() {}") }()
	return
}

func Map[T any](xs []T) []T { return xs }
"""


def test_go():
    symbols, imports, errors = _told(GO, "go")
    assert errors == 0
    assert [s for s in symbols if "parameter" not in s[0]] == [
        ("type_spec", "Server", "Server"),
        ("field_declaration", "name", "Server.name"),
        ("field_declaration", "log", "Server.log"),
        ("type_spec", "Runner", "Runner"),
        ("method_elem", "Run", "Runner.Run"),
        ("method_declaration", "Run", "Server.Run"),
        ("function_declaration", "Map", "Map"),
    ]
    assert [s[1] for s in symbols if "parameter" in s[0]] == ["ctx", "args", "s", "a", "c", "n", "err", "xs"]
    assert [k for k, _ in imports] == ["import_declaration", "import_spec_list", "import_spec", "import_spec"]
    assert imports[3][1] == 'str "strings"'


def test_go_of_one_line_and_broken():
    symbols, imports, errors = _told('package main\nimport "fmt"\ntype Server struct{}\nfunc (Server) Run() { fmt.Println("x") }\n', "go")
    assert symbols == [("type_spec", "Server", "Server"), ("method_declaration", "Run", "Server.Run")]
    assert imports == [("import_declaration", 'import "fmt"'), ("import_spec", '"fmt"')] and errors == 0
    assert _told("package broken\nfunc broken(\n", "go")[2] == 1
    for text in ('x := "open\n', "/* open", "a := 'x", "}", "func f() { (] }", "s := `open"):
        assert _told(text, "go")[2] >= 1, text


SCRIPT = """import x, { a, b as c } from './x.js';
import * as all from "all"
import './side.js';
// function inComment() {}
const re = /function inRegex() {}/g, half = 4 / 2 / 1;
const text = `function inTemplate() {} ${ [1, 2].map(function (v) { return `}${v}` }) } class No {}`;
export default async function run(a) { function inner() {} return "function inString() {}"; }
function* gen() {}
const arrow = () => { class Local { go() {} } };
export class App extends Base {
  static count = 1;
  constructor(x) { super(x); if (x) { this.call(x) } }
  async load() { return import('./lazy.js') }
  get size() { return 0 }
}
"""


def test_javascript():
    symbols, imports, errors = _told(SCRIPT, "javascript")
    assert errors == 0
    assert symbols == [
        ("function_declaration", "run", "run"),
        ("function_declaration", "inner", "run.inner"),
        ("generator_function_declaration", "gen", "gen"),
        ("class_declaration", "Local", "Local"),
        ("method_definition", "go", "Local.go"),
        ("class_declaration", "App", "App"),
        ("method_definition", "constructor", "App.constructor"),
        ("method_definition", "load", "App.load"),
        ("method_definition", "size", "App.size"),
    ]
    assert imports == [
        ("import_statement", "import x, { a, b as c } from './x.js';"),
        ("import_clause", "x, { a, b as c }"),
        ("named_imports", "{ a, b as c }"),
        ("import_specifier", "a"),
        ("import_specifier", "b as c"),
        ("import_statement", 'import * as all from "all"'),
        ("import_clause", "* as all"),
        ("namespace_import", "* as all"),
        ("import_statement", "import './side.js';"),
        ("import", "import"),
    ]


def test_typescript():
    text = "import { x } from './x'; export class App { run(): void {} }\nexport interface Shape { area(): number; name: string }\nexport type Id = string | number;\nenum Color { Red }\nabstract class Base {}\n"
    symbols, imports, errors = _told(text, "typescript")
    assert errors == 0 and imports[0] == ("import_statement", "import { x } from './x';")
    assert symbols == [
        ("class_declaration", "App", "App"),
        ("method_definition", "run", "App.run"),
        ("interface_declaration", "Shape", "Shape"),
        ("method_signature", "area", "Shape.area"),
        ("type_alias_declaration", "Id", "Id"),
        ("enum_declaration", "Color", "Color"),
        ("abstract_class_declaration", "Base", "Base"),
    ]


@pytest.mark.parametrize(("language", "text"), [("java", 'class A { String s = "class No {}"; /* class No2 {} */ }'), ("rust", "fn main() { // fn no() {}\n}\nstruct S;"), ("ruby", "def go # def no\nend"), ("shell", "function go { echo 'function no {'; }")])
def test_other_languages(language, text):
    symbols, _, errors = _told(text, language)
    assert errors == 0 and symbols and not any("no" in s[1].lower() for s in symbols)


def test_any_text_is_read_in_linear_time():
    rng = random.Random(2)
    parts = ["func", "class", "import", "function", "type", "(", ")", "{", "}", "`", '"', "'", "${", "/*", "*/", "//", "\n", "x", ";", ",", "from", "/", "=", "interface", "*", "static"]
    for language in ("go", "javascript", "typescript", "java"):
        for _ in range(700):
            text = " ".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
            for symbol in islands.islands(text, language).symbols:
                assert 0 <= symbol[3] < symbol[4] <= len(text)
    assert islands.islands("f(" * 300 + ")" * 300, "javascript").errors == []


def test_files_of_several_languages_are_analyzed(spark):
    rows = [("main.go", "go", 'package main\nimport "fmt"\n// é func no() {}\ntype Server struct{}\nfunc (s Server) Run() {}\n'), ("app.js", "javascript", "import x from './x.js'; export function run() {}\n"), ("broken.go", "go", "package broken\nfunc broken(\n"), ("a.py", "python", "import os\nclass A:\n    def f(self): return os\n"), ("x.zig", "zig", "fn a() {}")]
    files = spark.createDataFrame([(p, n, str(i), t) for i, (p, n, t) in enumerate(rows)], "path string, language string, digest string, text string")
    symbols, relations, diagnostics = code.analyze(files)
    texts = {p: t.encode() for p, _, t in rows}
    got = {(r.path, r.kind, r.qualified_name): r for r in symbols.collect()}
    assert {("main.go", "type_spec", "Server"), ("main.go", "method_declaration", "Server.Run"), ("main.go", "parameter_declaration", "Server.Run.s"), ("app.js", "function_declaration", "run"), ("a.py", "class", "A"), ("a.py", "function", "A.f"), ("broken.go", "function_declaration", "broken")} == set(got)
    run = got["main.go", "method_declaration", "Server.Run"]
    assert texts["main.go"][run.start_byte : run.end_byte] == b"func (s Server) Run() {}" and (run.start_line, run.start_column, run.end_line) == (5, 1, 5)
    of_python = got["a.py", "function", "A.f"]
    assert texts["a.py"][of_python.start_byte : of_python.end_byte] == b"def f(self): return os" and of_python.start_column == 5
    assert {(r.path, r.target) for r in relations.where("kind = 'import'").collect()} == {("main.go", 'import "fmt"'), ("main.go", '"fmt"'), ("app.js", "import x from './x.js';"), ("app.js", "x")}
    assert {(r.path, r.message) for r in diagnostics.collect()} == {("broken.go", "line 2: ( is not closed")}
