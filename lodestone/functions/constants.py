"""Names and numbers that must be as they are for results to be right."""

# Folders that are never walked.
IGNORED_DIRS = [
    ".git", "node_modules", ".pnpm", "bower_components", "vendor", "dist", "build", "out", "target", ".next", ".nuxt", ".svelte-kit", ".turbo",
    "coverage", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", ".gradle", ".idea", ".vscode", ".cache", "tmp", "Pods",
    "DerivedData", ".terraform", "elm-stuff", ".dart_tool",
]

# Lock files, in lower case.
LOCKFILES = [
    "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "composer.lock", "cargo.lock", "poetry.lock",
    "pipfile.lock", "gemfile.lock", "go.sum", "flake.lock", "packages.lock.json", "podfile.lock", "mix.lock",
]

# Extensions of files that hold no text.
BINARY_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".ico", ".icns", ".svg", ".pdf", ".zip", ".gz", ".tar", ".tgz", ".bz2", ".xz", ".7z", ".rar",
    ".jar", ".war", ".class", ".so", ".dylib", ".dll", ".exe", ".bin", ".o", ".a", ".wasm", ".woff", ".woff2", ".ttf", ".otf", ".eot", ".mp3", ".mp4",
    ".mov", ".avi", ".webm", ".wav", ".flac", ".ogg", ".lock", ".min.js", ".map",
]

# Languages and their extensions.
LANGUAGE_OF = {
    ".ts": "typescript",
    ".tsx": "typescript",
    ".mts": "typescript",
    ".cts": "typescript",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".py": "python",
    ".pyi": "python",
    ".go": "go",
    ".rb": "ruby",
    ".rake": "ruby",
    ".java": "java",
    ".rs": "rust",
    ".c": "c",
    ".h": "c",
    ".cc": "cpp",
    ".cpp": "cpp",
    ".cxx": "cpp",
    ".hpp": "cpp",
    ".hh": "cpp",
    ".cs": "csharp",
    ".php": "php",
    ".swift": "swift",
    ".kt": "kotlin",
    ".kts": "kotlin",
    ".scala": "scala",
    ".sc": "scala",
    ".clj": "clojure",
    ".ex": "elixir",
    ".exs": "elixir",
    ".erl": "erlang",
    ".hs": "haskell",
    ".dart": "dart",
    ".lua": "lua",
    ".sh": "shell",
    ".bash": "shell",
    ".zsh": "shell",
    ".ksh": "shell",
    ".fish": "shell",
    ".m": "objective-c",
    ".mm": "objective-c",
    ".sql": "sql",
    ".graphql": "graphql",
    ".gql": "graphql",
    ".proto": "protobuf",
    ".md": "markdown",
    ".mdx": "markdown",
    ".rst": "restructuredtext",
    ".txt": "text",
    ".json": "json",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".toml": "toml",
    ".ini": "ini",
    ".html": "html",
    ".css": "css",
    ".scss": "scss",
    ".vue": "vue",
    ".svelte": "svelte",
    ".astro": "astro",
}
NOT_CODE = ["markdown", "restructuredtext", "text", "json", "yaml", "toml", "ini", "other", "html", "css", "scss"]

# What is documentation and what configures.
DOC_EXTENSIONS = [".md", ".mdx", ".rst", ".adoc", ".txt"]
DOC_BASENAME = r"^(readme|changelog|contributing|history|news|authors|notice|security|code_of_conduct|faq|getting[-_]?started|usage|guide|tutorial)\b"
DOC_DIR = r"(?i)^(docs?|documentation|wiki|guides?|website|site|book)/"
CONFIG_NAMES = [
    "package.json", "pnpm-workspace.yaml", "tsconfig.json", "jsconfig.json", "pyproject.toml", "setup.py", "setup.cfg", "requirements.txt", "pipfile",
    "go.mod", "cargo.toml", "gemfile", "pom.xml", "build.gradle", "build.gradle.kts", "composer.json", "mix.exs", "pubspec.yaml", "build.sbt",
    "dockerfile", "docker-compose.yml", "docker-compose.yaml", "makefile", ".env.example", "manifest.json",
]
CONFIG_EXTENSIONS = [".json", ".yaml", ".yml", ".toml", ".ini", ".cfg"]

# The ten roles of a file.
CODE_ROLE = [
    ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte", ".astro", ".py", ".rb", ".go", ".rs", ".java", ".kt", ".kts",
    ".php", ".c", ".cc", ".cpp", ".h", ".hpp", ".cs", ".swift", ".scala", ".clj", ".ex", ".exs", ".dart", ".lua", ".sh", ".bash", ".zig", ".elm",
]
STYLE_ROLE = [".css", ".scss", ".sass", ".less", ".styl", ".pcss"]
DATA_ROLE = [".json", ".yaml", ".yml", ".toml", ".csv", ".xml", ".env"]
ASSET_ROLE = [
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".avif", ".ico", ".bmp", ".tiff", ".svg", ".pdf", ".woff", ".woff2", ".ttf", ".otf", ".eot", ".mp3",
    ".mp4", ".mov", ".avi", ".webm", ".zip", ".gz", ".tar", ".rar", ".7z", ".wasm", ".so", ".dylib", ".dll", ".exe", ".bin", ".class", ".jar", ".pyc",
    ".node",
]
I18N_DIRS = ["locales", "locale", "i18n", "lang", "langs", "translations", "messages"]
I18N_EXTENSIONS = [".json", ".yaml", ".yml", ".po", ".properties"]
TEST_DIRS = ["__tests__", "test", "tests", "spec", "e2e", "__mocks__"]
SCHEMA_DIRS = ["migrations", "entities", "models"]
SCHEMA_EXTENSIONS = [".prisma", ".sql", ".graphql", ".gql"]
CONFIG_ROLE = [
    "package.json", "tsconfig.json", "dockerfile", "makefile", "pyproject.toml", "cargo.toml", "go.mod", "requirements.txt", "gemfile",
    "composer.json", "pubspec.yaml",
]

# Paths of tests, of foundations and of the tail, and of entry points.
TEST_DIR = r"(?i)(^|/)(tests?|__tests?__|spec|specs|e2e)(/|$)"
TEST_FILE = r"(?i)\.(test|spec|e2e|stories|story)\.[cm]?[jt]sx?$"
TEST_NAMES = [r"(?i)(^|/)test_[^/]*\.py$", r"(?i)_test\.py$", r"_test\.go$", r"(Test|Tests|IT)\.java$", r"(Test|Tests)\.kt$", r"_spec\.rb$", r"_test\.rb$", r"Test\.php$", r"(Test|Tests)\.cs$", r"_test\.exs$"]
ROOT = "(root)"
TIER0 = r"(?i)(^|/)(types?|util|utils|lib|libs|common|core|config|configs|constants|shared|helpers|internal)$"
TIER2_ANY = r"(?i)(^|/)(tests?|__tests?__|__mocks?__|__snapshots?__|spec|specs|e2e|examples?|example|benchmark|benchmarks|fixtures?|docs?|documentation|\.github)(/|$)"
TIER2_LEAF = r"(?i)(^|/)(scripts?|bin|\.storybook)$"
ENTRY_PATH = r"(^|/)(index|main|cli|app|server|engine)\.[a-z]+$"
ENTRY_STEMS = [
    "index", "main", "app", "application", "cli", "server", "entry", "entrypoint", "setup", "conftest", "__init__", "__main__", "mod", "lib",
]

# Words that carry no meaning in a question.
STOPWORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "do", "does", "did", "how", "what", "why", "when", "where", "which", "who",
    "whom", "this", "that", "these", "those", "of", "in", "on", "to", "for", "with", "and", "or", "but", "if", "then", "else", "than", "as", "at",
    "by", "from", "into", "about", "it", "its", "i", "you", "we", "they", "he", "she", "there", "here", "can", "could", "should", "would", "will",
    "shall", "may", "might", "must", "have", "has", "had", "not", "no", "yes", "so", "such", "only", "any", "some", "all", "get", "set", "use",
    "used", "using", "work", "works", "working", "handle", "handled", "happen", "happens", "default", "value", "values", "please", "explain", "tell",
    "me", "my", "our",
]

# Limits.
MAX_FILE_BYTES, MAX_FILES = 1_048_576, 20_000
MAX_SYMBOLS, MAX_CALLS, MAX_IDENTS, MAX_REEXPORTS, SIGNATURE = 400, 512, 256, 60, 200
WEIGHT_CAP = 5
K1, B, SEARCH_LIMIT, TOP_SYMBOLS, DICE, FUZZY_CAP = 1.2, 0.75, 20, 5, 0.6, 3
DAMPING, ITERATIONS, L1_STOP = 0.85, 100, 1e-10
BETWEENNESS_NODES = 3000
SWEEPS, PASSES, EPS, OVERSIZE_SHARE, OVERSIZE_MIN = 20, 10, 1e-12, 0.25, 10
SURPRISES, SURPRISE_PAIR = 24, 2
COUPLING_FILES, COUPLING_TOGETHER, COUPLING_PAIRS = 30, 3, 100
TOP_HOTSPOTS, TOP_COMPLEXITY, FIND_LIMIT, GREP_LIMIT, MERMAID_EDGES = 20, 50, 50, 200, 80
MAP_TOKENS, MAP_SYMBOLS, CHARS_PER_TOKEN = 1024, 8, 4
RRF_K, QUANTUM = 60, 127
LIFT_RANK = {"import": 5, "call": 4, "use": 3, "doc-link": 2, "mention": 1}
REFERENCE_KINDS = ["reexport", "reexport-all", "default"]
