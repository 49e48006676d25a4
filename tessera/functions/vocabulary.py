"""Closed word lists of the knowledge model. All values in this module are fixed."""

from __future__ import annotations

#: The closed predicate vocabulary, by category; anything else becomes FALLBACK.
PREDICATES: dict[str, tuple[str, ...]] = {
    "dependencies": ("uses", "dependsOn", "requires", "builtWith"),
    "capabilities": ("enables", "provides", "solves", "produces"),
    "structure": ("isPartOf", "hasPart", "extends", "implements"),
    "taxonomy": ("isTypeOf", "broader", "narrower"),
    "infrastructure": ("deployedOn", "storesIn", "queriedWith", "configures"),
    "relationships": ("integratesWith", "composesWith", "alternativeTo", "servesAs", "relatedTo"),
}
FALLBACK = "relatedTo"
ALL_PREDICATES = tuple(p for group in PREDICATES.values() for p in group)
#: Super-properties that some predicates specialise.
SUPER_PROPERTIES = {"isPartOf": "dcterms:isPartOf", "hasPart": "dcterms:hasPart", "broader": "skos:broader", "narrower": "skos:narrower", "relatedTo": "skos:related"}

#: Names that are never entities.
STOPWORDS = (
    "command name", "exit", "yes", "no", "ok", "the", "it", "this", "that", "none", "null", "undefined", "true", "false", "n/a",
    "[object object]", "object object",
)
#: Short terms that always are.
WHITELIST = (
    "ai", "ui", "db", "os", "ip", "ci", "cd", "js", "ts", "go", "ml",
    "api", "sdk", "sql", "css", "jwt", "ssh", "ssl", "tls", "dns", "cdn",
    "gpu", "cpu", "ram", "ssd", "hdd", "cli", "gui", "ide", "nlp", "llm",
    "rag", "rdf", "owl", "uri", "url", "xml", "csv", "pdf", "svg", "png",
    "gif", "npm", "pip", "git", "aws", "gcp", "mcp", "rpa",
)
TWO_LETTER_TERMS = ("ai", "ui", "db", "os", "ip", "ci", "cd", "js", "ts", "go", "ml")
#: File extensions of the extraction filter, and those of the link filter.
EXTENSIONS = (
    "ts", "tsx", "js", "jsx", "py", "json", "yaml", "yml", "css", "html", "md", "sql", "sh", "env", "db", "sqlite", "txt",
    "png", "csv", "jsonl", "xml", "toml", "lock", "cfg", "ini", "log", "ttl", "rdf", "sparql", "ipynb", "whl", "gz",
    "tar", "zip", "jpg", "jpeg", "gif", "svg", "wasm", "map", "d.ts", "mjs", "cjs",
)
LINK_EXTENSIONS = (
    "ts", "tsx", "js", "jsx", "py", "json", "yaml", "yml", "css", "html", "md", "sql", "sh", "env", "db", "sqlite", "txt",
    "png", "csv", "jsonl", "xml", "toml", "lock", "cfg", "ini", "log", "ttl", "rdf", "sparql", "ipynb", "whl", "gz",
    "tar", "zip", "pyc", "appimage", "dmg", "exe", "npz", "rq",
)
#: Words whose presence in a description speaks for a technical sense.
TECH_KEYWORDS = (
    "software", "database", "framework", "library", "programming", "language", "tool", "platform", "application", "system",
    "service", "api", "protocol", "standard", "specification", "technology", "infrastructure", "container", "orchestration",
)

#: Spellings and the name each stands for. Fixed values.
CANONICAL: dict[str, str] = {
    "js": "javascript", "ts": "typescript", "py": "python", "k8s": "kubernetes", "tf": "tensorflow", "gcp": "google cloud platform",
    "aws": "amazon web services", "ml": "machine learning", "ai": "artificial intelligence", "dl": "deep learning", "nlp": "natural language processing",
    "llm": "large language model", "llms": "large language model", "kg": "knowledge graph", "rag": "retrieval augmented generation",
    "ci/cd": "continuous integration", "dmz": "demilitarized zone", "otlp": "opentelemetry", "otel": "opentelemetry", "ssh": "secure shell",
    "ssh overhead": "secure shell", "csv": "comma-separated values", "csv data": "comma-separated values", "env vars": "environment variable",
    "sql": "sql", "db": "database", "vscode": "visual studio code", "vs code": "visual studio code", "warp": "warp terminal",
    "warp terminal": "warp terminal", "react.js": "react", "reactjs": "react", "node.js": "node.js", "nodejs": "node.js", "nextjs": "next.js",
    "next.js": "next.js", "vue.js": "vue.js", "vuejs": "vue.js", "postgres": "postgresql", "mongo": "mongodb", "graphql": "graphql",
    "rest api": "representational state transfer", "rest apis": "representational state transfer", "restful": "representational state transfer",
    "restful api": "representational state transfer", "api gateway": "api management", "cloud run": "google cloud run",
    "gcp cloud run": "google cloud run", "cloud functions": "google cloud functions", "cloud function": "google cloud functions",
    "lambda layers": "aws lambda", "lambda": "aws lambda", "bedrock": "amazon bedrock", "bedrock agents": "amazon bedrock",
    "serverless": "serverless computing", "serverless services": "serverless computing", "edge computing": "edge computing",
    "oracle db": "oracle database", "oracle server": "oracle database", "oracle db server": "oracle database", "oracle db tunneling": "oracle database",
    "sqlite": "sqlite", "embedded sqlite": "sqlite", "websocket": "websocket", "websockets": "websocket", "websocket connection": "websocket",
    "websocket server": "websocket", "websocket library": "websocket", "websocket tls": "websocket", "websocket tunnels": "websocket",
    "async websocket": "websocket", "distributed systems": "distributed computing", "environment variables": "environment variable",
    "docker containers": "docker", "stateless containers": "docker", "json readability": "json", "json string": "json",
    "naive bayes": "naive bayes classifier", "naive bayes model": "naive bayes classifier", "naive bayes applications": "naive bayes classifier",
    "naive bayes (enhanced kb)": "naive bayes classifier", "problog": "problog", "problog inference": "problog", "problog (enhanced kb)": "problog",
    "problog kb": "problog", "problogs kb": "problog", "prolog": "prolog", "prolog facts": "prolog", "prolog fact": "prolog",
    "prolog-based systems": "prolog", "pure prolog": "prolog", "claude": "claude ai", "claude code": "claude ai", "claude mcp": "model context protocol",
    "mcp server": "model context protocol", "mcp servers": "model context protocol", "mcp adapter": "model context protocol",
    "mcp adapters": "model context protocol", "raspberry pi": "raspberry pi", "raspberry pi rest api": "raspberry pi", "rock pi #1": "rock pi",
    "rock pi #2": "rock pi", "fosfomycin": "fosfomycin", "mayo clinic": "mayo clinic", "mayioclinic": "mayo clinic", "word document": "microsoft word",
    "asp/clingo": "answer set programming", "clingo/asp": "answer set programming", "asp": "answer set programming", "clingo": "clingo",
    "notion mcp": "notion", "@notionhq/mcp-server": "notion", "@notionhq/notion-mcp-server": "notion", "@anthropic-ai/claude-code": "claude ai",
    "@opentelemetry/sdk-node": "opentelemetry", "npx": "npm", "tavily": "tavily", "tavily-mcp": "tavily", "sql client": "sql", "sql queries": "sql",
    "sql-over-tunnel": "sql", "apple terminal": "terminal", "myconnect": "myconnect", "myconnect client": "myconnect",
    "warpdotdev/claude-code-warp": "warp terminal", "warp native notification system": "warp terminal", "warp notification": "warp terminal",
    "native warp notification": "warp terminal", "native warp terminal notifications": "warp terminal", "makenotion/notion-mcp-server": "notion",
    "osc 777 escape sequences": "operating system command", "analgesia": "analgesia", "medicamentos": "medication", "medications": "medication",
    "disease": "disease", "schema": "database schema", "subagent": "software agent", "weather api": "weather api", "port 1521": "oracle database",
    "prototype language": "prototype-based programming", "erp schema": "enterprise resource planning", "ddxplus": "ddxplus",
    "ddxplus dataset": "ddxplus", "ddxplus knowledge base": "ddxplus", "weighted boolean formula": "weighted boolean formula",
    "weighted boolean formulas": "weighted boolean formula", "outbound websocket": "websocket", "websocket (tls) text": "websocket",
    "context7": "context7",
}
