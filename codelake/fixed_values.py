"""Lists, tables, patterns and limits that results depend on.

Everything in this module is data. The entries are stated in their natural
order so they can be compared with the behaviour they have to reproduce.
"""

# ---- Fixed values: limits ---------------------------------------------------
MAX_SEARCH_RESULTS = 200
MAX_LOG_COMMITS = 200
DEFAULT_PAGE_SIZE = 50
MAX_PAGE_SIZE = 200
SUMMARY_SECTION_ROWS = 5
FILE_EDGE_EXAMPLES = 3

# ---- Fixed values: eligibility ----------------------------------------------
IGNORED_FOLDERS = [
    "bin", "obj", ".git", ".vs", ".idea", ".vscode",
    "node_modules", "packages", ".nuget",
    "vendor", "third_party", "thirdparty",
    "dist", "build", "out", "output",
    ".mcp_backups", ".mcp",
    "testresults", ".testresults",
    "coverage",
    "__pycache__", ".pytest_cache",
    "target",
    ".gradle",
]

EXCLUDED_EXTENSIONS = [
    ".exe", ".dll", ".pdb", ".lib", ".a", ".so", ".dylib",
    ".msi", ".msix", ".nupkg",
    ".zip", ".7z", ".rar", ".tar", ".gz", ".bz2", ".xz",
    ".bin", ".cache", ".suo", ".user",
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".webp",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx",
    ".mp3", ".mp4", ".avi", ".mov",
    ".ttf", ".woff", ".woff2", ".eot",
]

TEMP_SUFFIXES = ["~", ".tmp", ".bak"]

GENERATED_SUFFIXES = [".designer.cs", ".g.cs", ".generated.cs", ".g.i.cs"]
GENERATED_NAMES = ["assemblyinfo.cs", "assemblyattributes.cs"]
GENERATED_FRAGMENTS = [".min.js", ".min.css", ".bundle.js"]

# ---- Fixed values: binary detection -----------------------------------------
BINARY_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".tiff", ".webp",
    ".mp3", ".mp4", ".avi", ".mkv", ".mov", ".wav", ".ogg",
    ".zip", ".7z", ".rar", ".tar", ".gz", ".bz2",
    ".exe", ".dll", ".pdb", ".so", ".bin", ".dat",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
]
BINARY_CONTROL_PERCENT = 30

# ---- Fixed values: access lists ---------------------------------------------
BLOCKED_FOLDERS = [
    ".git", "bin", "obj", ".vs", "packages", "node_modules", ".idea", ".vscode",
    "TestResults", ".nuget", ".mcp_backups", ".mcp",
]
BLOCKED_EXTENSIONS = [
    ".exe", ".dll", ".pdb", ".msi", ".zip", ".7z", ".rar", ".tar", ".gz", ".bz2",
    ".bin", ".cache", ".suo", ".user",
]

# ---- Fixed values: languages ------------------------------------------------
LANGUAGE_BY_EXTENSION = {
    ".cs": "csharp",
    ".vb": "vbnet",
    ".fs": "fsharp", ".fsi": "fsharp", ".fsx": "fsharp",
    ".ts": "typescript", ".tsx": "typescript",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".py": "python", ".pyw": "python",
    ".java": "java",
    ".go": "go",
    ".rs": "rust",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hxx": "cpp",
    ".h": "c", ".c": "c",
    ".json": "json",
    ".xml": "xml", ".xaml": "xml", ".csproj": "xml", ".vbproj": "xml",
    ".fsproj": "xml", ".props": "xml", ".targets": "xml",
    ".html": "html", ".htm": "html", ".cshtml": "html", ".razor": "html",
    ".css": "css", ".scss": "css", ".sass": "css", ".less": "css",
    ".sql": "sql",
    ".sh": "shell", ".bash": "shell", ".zsh": "shell",
    ".ps1": "powershell", ".psm1": "powershell", ".psd1": "powershell",
    ".md": "markdown", ".mdx": "markdown", ".markdown": "markdown",
}

# First hit wins.
LANGUAGE_BY_SHEBANG = [
    ("python3", "python"),
    ("python", "python"),
    ("node", "javascript"),
    ("bash", "shell"),
    ("sh", "shell"),
    ("zsh", "shell"),
    ("ruby", "unknown"),
    ("perl", "unknown"),
]

PARSED_LANGUAGES = ["csharp", "python"]

MIME_BY_EXTENSION = {
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".gif": "image/gif",
    ".webp": "image/webp",
    ".bmp": "image/bmp",
    ".svg": "image/svg+xml",
    ".ico": "image/x-icon",
    ".mp3": "audio/mpeg",
    ".wav": "audio/wav",
    ".ogg": "audio/ogg",
    ".flac": "audio/flac",
    ".mp4": "video/mp4",
    ".webm": "video/webm",
    ".pdf": "application/pdf",
    ".zip": "application/zip",
}
MIME_DEFAULT = "application/octet-stream"

# ---- Fixed values: resolution -----------------------------------------------
EXTERNAL_TYPES = [
    "string", "int", "long", "bool", "double", "float", "decimal", "byte",
    "object", "void", "char", "short", "uint", "ulong", "sbyte", "ushort",
    "IEnumerable", "IList", "ICollection", "IDictionary", "IReadOnlyList",
    "IReadOnlyDictionary", "IReadOnlyCollection", "IComparable", "IEquatable",
    "IDisposable", "ICloneable", "Nullable", "List", "Dictionary", "HashSet",
    "Queue", "Stack", "SortedList", "SortedDictionary", "LinkedList",
    "Array", "Exception", "ArgumentException", "ArgumentNullException",
    "InvalidOperationException", "NotImplementedException", "NotSupportedException",
    "Task", "ValueTask", "CancellationToken", "Stream", "TextWriter", "TextReader",
    "StringBuilder", "Guid", "DateTime", "DateTimeOffset", "TimeSpan",
    "Console", "Math", "String", "Int32", "Boolean", "Object",
    "Action", "Func", "Predicate", "EventHandler", "EventArgs",
    "list", "dict", "tuple", "set", "frozenset", "str", "bytes",
    "bytearray", "memoryview", "complex", "type",
]

PLAIN_IMPORT_KINDS = ["using", "import", "from-import"]

CONFIDENCE = {
    "ExactBound": 1.0,
    "ScopedBound": 0.9,
    "ImportBound": 0.95,
    "Ambiguous": 0.7,
    "External": 0.8,
}
CONFIDENCE_UNKNOWN_WITH_SOURCE = 0.85
CONFIDENCE_UNKNOWN = 0.6

RESOLUTION_METHOD = {
    "ExactBound": "exact",
    "ScopedBound": "scoped",
    "ImportBound": "import-qualified",
    "AliasBound": "alias",
    "Ambiguous": "ambiguous",
    "External": "external",
}
RESOLUTION_METHOD_DEFAULT = "unresolved"

HARD_CLASSES = ["ExactBound", "ScopedBound", "ImportBound", "AliasBound"]

PREDEFINED_TYPES = [
    "bool", "byte", "sbyte", "short", "ushort", "int", "uint", "long", "ulong",
    "double", "float", "decimal", "string", "char", "object", "void",
]

# ---- Fixed values: symbol kinds ---------------------------------------------
# (language, node kind, subkind) -> symbol kind
SYMBOL_KINDS = {
    ("csharp", "Container", "namespace"): "Namespace",
    ("csharp", "Declaration", "class"): "Class",
    ("csharp", "Declaration", "struct"): "Struct",
    ("csharp", "Declaration", "interface"): "Interface",
    ("csharp", "Declaration", "enum"): "Enum",
    ("csharp", "Declaration", "record"): "Record",
    ("csharp", "Declaration", "record class"): "Record",
    ("csharp", "Declaration", "record struct"): "Record",
    ("csharp", "Declaration", "delegate"): "TypeAlias",
    ("csharp", "Callable", "method"): "Method",
    ("csharp", "Callable", "constructor"): "Constructor",
    ("csharp", "Member", "property"): "Property",
    ("csharp", "Member", "indexer"): "Property",
    ("csharp", "Member", "field"): "Field",
    ("csharp", "Member", "event"): "Event",
    ("python", "Container", "module"): "Module",
    ("python", "Declaration", "class"): "Class",
    ("python", "Callable", "function"): "Function",
    ("python", "Callable", "async function"): "Function",
    ("python", "Callable", "method"): "Method",
    ("python", "Callable", "async method"): "Method",
}

KIND_CATEGORY = {
    "Namespace": "ns",
    "Package": "mod", "Module": "mod", "Script": "mod",
    "Class": "type", "Struct": "type", "Interface": "type", "Enum": "type",
    "Record": "type", "Trait": "type", "Union": "type", "TypeAlias": "type",
    "Object": "type",
    "Method": "callable", "Function": "callable", "Constructor": "callable",
    "Procedure": "callable", "Getter": "callable", "Setter": "callable",
    "Property": "member", "Field": "member", "Constant": "member",
    "Event": "member", "Variable": "member",
}
KIND_CATEGORY_DEFAULT = "sym"

TYPE_KINDS = [
    "Class", "Struct", "Interface", "Enum", "Record", "Trait", "Union",
    "TypeAlias", "Object",
]
CONTAINER_KINDS = ["Namespace", "Module", "Package", "Script"]
VISIBILITY_WORDS = ["public", "private", "protected", "internal"]
SEMANTIC_NODE_KINDS = ["Declaration", "Callable", "Member"]

FLAG_HAS_DECLARATIONS = 1
FLAG_HAS_MEMBERS = 32

# ---- Fixed values: line patterns --------------------------------------------
PY_CLASS = r"^([ \t]*)class\s+([A-Za-z_][A-Za-z0-9_]*)(?:\s*\(([^)]*)\))?\s*:"
PY_DEF = (
    r"^([ \t]*)(async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(([^)]*)\)"
    r"(?:\s*->\s*([^:]+))?\s*:"
)
PY_IMPORT = (
    r"^[ \t]*import\s+([A-Za-z_][A-Za-z0-9_.]*?)"
    r"(?:\s+as\s+([A-Za-z_][A-Za-z0-9_]*))?\s*$"
)
PY_FROM_IMPORT = (
    r"^[ \t]*from\s+(\.+[A-Za-z0-9_.]*|[A-Za-z_][A-Za-z0-9_.]*)?\s+import\s+(.+?)\s*$"
)
INTERFACE_NAME = r"^I\p{Lu}"

STRUCTURE_NAMESPACE = r"^\s*namespace\s+([\w.]+)"
STRUCTURE_TYPE = (
    r"^\s*(public|internal|protected|private|sealed|abstract|static|partial).*?"
    r"(class|interface|struct|enum)\s+(\w+)"
)
STRUCTURE_METHOD = (
    r"^\s*(public|internal|protected|private|static|virtual|override|async|sealed|abstract)"
    r"\s+[\w<>\[\],\s]+\s+(\w+)\s*\("
)
STRUCTURE_USING = r"^\s*using\s+([\w.]+)\s*;"

SOLUTION_PROJECT = r'(?i)Project\("\{[^}]+\}"\)\s*=\s*"([^"]+)"\s*,\s*"([^"]+)"'
PROJECT_EXTENSIONS = [
    ".csproj", ".vbproj", ".fsproj", ".sqlproj", ".wixproj", ".ccproj", ".pyproj",
]
TARGET_FRAMEWORK = r"(?i)<TargetFramework(?:Version|)>\s*([^<]+)\s*</TargetFramework"
OUTPUT_TYPE = r"(?i)<OutputType>\s*([^<]+)\s*</OutputType>"
PACKAGE_REFERENCE = (
    r'(?i)<PackageReference\s+Include="([^"]+)"\s+Version="([^"]+)"'
)
PROJECT_REFERENCE = r'(?i)<ProjectReference\s+Include="([^"]+)"'
TEST_NAME_WORDS = ["test", "spec"]
TEST_CONTENT_WORDS = ["xunit", "nunit", "mstest", "microsoft.visualstudio.testplatform"]

HUNK_HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)"
DIFF_HEADER = r"^diff --git a/(.+) b/(.+)$"

BUILD_DIAGNOSTIC = (
    r"(?i)^([^(]+)\((\d+),(\d+)\): (error|warning) (\w+): (.+)$"
)
TEST_TOTAL = r"(?i)Total tests:\s*(\d+)"
TEST_PASSED = r"(?i)Passed:\s*(\d+)"
TEST_FAILED = r"(?i)Failed:\s*(\d+)"
TEST_SKIPPED = r"(?i)Skipped:\s*(\d+)"
