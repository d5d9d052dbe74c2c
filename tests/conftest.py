import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from codeloom.runtime import ship

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    return session


TREE = {
    ".gitignore": "out/\n*.tmp\ncache/\nlogs/\nprivate.env\n",
    "README.md": "# Ember\n\nKeeps notes as small blocks and serves them.\n",
    "ember/__init__.py": '"""Notes in blocks."""\n\n__version__ = "1"\n',
    "ember/blocks.py": "from dataclasses import dataclass\n\n\n@dataclass\nclass Block:\n    kind: str\n    body: str\n\n\ndef cut_blocks(text):\n    \"\"\"Cuts a note where lines are empty.\"\"\"\n    return [Block('text', part) for part in text.split('\\n\\n') if _useful(part)]\n\n\ndef _useful(part):\n    return bool(part.strip())\n",
    "ember/parser.py": "from ember.blocks import Block, cut_blocks\n\n\nclass NoteParser:\n    def __init__(self, strict=False):\n        self.strict = strict\n\n    def parse(self, text):\n        return cut_blocks(text)\n\n    def headings(self, text):\n        return [b for b in self.parse(text) if b.body.startswith('#')]\n\n\ndef parse_note(text):\n    return NoteParser().parse(text)\n",
    "ember/store.py": "import json\n\nfrom ember.blocks import Block\n\n\nclass NoteStore:\n    def save(self, path, blocks):\n        with open(path, 'w') as f:\n            json.dump([b.__dict__ for b in blocks], f)\n\n    def load(self, path):\n        with open(path) as f:\n            return [Block(**b) for b in json.load(f)]\n",
    "ember/server.py": "from http.server import BaseHTTPRequestHandler, HTTPServer\n\nfrom ember.parser import parse_note\nfrom ember.store import NoteStore\n\n\nclass NoteHandler(BaseHTTPRequestHandler):\n    store = NoteStore()\n\n    def do_GET(self):\n        self.send_response(200)\n        self.end_headers()\n        self.wfile.write(repr(parse_note('hello')).encode())\n\n\nif __name__ == '__main__':\n    HTTPServer(('', 8080), NoteHandler).serve_forever()\n",
    "web/main.js": "import { draw } from './render';\nimport { Shelf } from './store.js';\n\nconst shelf = new Shelf();\ndraw(document.body, shelf.all());\n",
    "web/render.js": "export function draw(root, notes) {\n  for (const n of notes) {\n    root.append(line(n));\n  }\n}\n\nexport function line(note) {\n  const p = document.createElement('p');\n  p.textContent = note;\n  return p;\n}\n",
    "web/store.js": "export class Shelf {\n  constructor() {\n    this.notes = [];\n  }\n\n  all() {\n    return this.notes;\n  }\n}\n",
    "scripts/release.sh": "#!/bin/bash\nset -e\ntag() {\n  git tag \"$1\"\n}\ntag \"$1\"\n",
    "scripts/build.py": "from ember.parser import parse_note\n\nprint(len(parse_note(open('README.md').read())))\n",
    "out/generated.js": "var x = 1;\n",
    "private.env": "KEY=1\n",
}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "ember"
    for path, content in TREE.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(content)
    return root
