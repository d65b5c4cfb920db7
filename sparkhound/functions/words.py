"""Word lists that decide results. Plain, in natural order."""

# Names that give user-controlled values; matched as prefixes.
SOURCES = [
    "params", "request", "req", "get_body", "query", "io.get_line", "dynamic.unsafe_coerce", "request.get_body", "user_url", "user_input", "url", "path", "cmd",
    "command", "input", "env", "ARGV", "STDIN", "gets", "event", "payload", "body", "data", "msg", "message", "headers", "cookie", "session", "form", "form_data",
    "raw_params", "os.getEnv", "os.getEnvOrDefault", "os.commandLineParams", "os.paramStr", "os.paramCount", "stdin.readLine", "readLine", "readFile",
    "httpclient.getContent", "httpclient.postContent", "httpclient.get", "httpclient.post", "net.recv", "net.recvFrom", "net.recvLine", "asyncnet.recv",
    "asyncnet.recvLine", "streams.readLine", "streams.readAll", "streams.readStr", "uri.parseUri", "json.parseJson",
]
# Names that give safe values; matched anywhere in a call's name.
SANITIZERS = [
    "URI.encode", "URI.decode", "Path.posix", "Path.basename", "Path.dirname", "String.strip", "String.trim", "String.slice", "Int.parse", "Float.parse",
    "validator.", "sanitize.", "escape.", "encode.", "cgi.escape", "html.escape", "check_ssrf", "check_ssrf_url", "validate_url", "is_valid_url",
    "allowlisted_url?", "valid_url?", "url_valid?", "validate_", "check_", "verify_", "guard_", "validate", "check", "verify", "guard", "Digest::MD5.hexdigest",
    "Digest::SHA256.hexdigest", "Base64.encode", "Base64.strict_encode", "File.expand_path", "OpenSSL::Digest", "hash_for_url", "hash_for", "favicon_hash",
    "hexdigest", "hexstring", "to_hex", "SHA256", "SHA512", "SHA1", "MD5", "get_or_fetch", "Random::Secure", "Tempfile", "Dir.mktmpdir", "File.tempname",
    "mkstemp", "Config.from_json", "Config.from_yaml", "Config.parse", "validate_yaml_structure", "validate_config", "load_config", "read_config",
]
# Methods whose result is as tainted as their receiver, also with "!".
STRING_METHODS = [
    "upcase", "downcase", "capitalize", "strip", "lstrip", "rstrip", "reverse", "chomp", "chop", "squeeze", "gsub", "sub", "replace", "split", "lines", "chars",
    "bytes", "strip_margin", "indent", "tr", "delete", "prepend", "concat", "encode", "decode", "<>", "+", "Kernel.to_string",
]
URI_CONSTRUCTORS = ["URI.parse", "URI.new", "URL.parse", "URL.new"]
URI_FIELDS = ["host", "request_target", "path", "query", "full_path", "scheme"]
# Entry points.
HTTP_PARAMS = ["params", "request", "req", "context", "ctx", "conn", "HTTP::Request", "HTTP::Server::Context", "HTTP::Params", "get_body", "query"]
HTTP_FUNCTIONS = ["handle_", "get_", "post_", "put_", "delete_", "patch_", "index", "show", "create", "update", "destroy"]
CLI_FUNCTIONS = ["main", "run", "cli", "execute"]
CLI_PARAMS = ["ARGV", "STDIN", "gets", "args", "env"]
# Calls after which findings count as checked.
AUTH_WORDS = [
    "require_admin", "require_auth", "require_user", "authenticate", "authorize", "before_action", "before_filter", "protect_from_forgery",
    "ensure_authenticated", "ensure_authorized", "login_required", "auth_required", "signed_in?", "current_user", "require_login!", "require_auth!",
]
VALID_SUFFIXES = ["valid?", "safe?", "secure?", "allowed?"]
VALID_WORDS = ["validate", "sanitize", "check", "verify"]
SCHEME_SUFFIXES = ["starts_with?", "end_with?"]
AUTH_RULES = ["SSRF", "OpenRedirect", "ScentLeakage", "InsecureDeserialization", "PathTraversal"]
VALIDATED_RULES = ["ssrf", "path_traversal", "PathTraversal", "CommandInjection", "OpenRedirect", "SQLInjection", "InsecureDeserialization"]
# Smells.
DECISIONS = ["if", "unless", "case", "select", "&&", "||", "and ", "or ", "loop", "while", "for ", "each", "exception_handler"]
FLAG_PREFIXES = ["should_", "enable_", "disable_", "use_", "include_", "allow_", "force_", "skip_", "no_", "with_"]
FLAG_NAMES = ["verbose", "debug", "dry_run", "strict", "quiet"]
SQL_WORDS = ["select", "insert", "update", "delete", "create"]
SECRET_PREFIXES = ["sk_", "sk_live_", "sk_test_", "ghp_", "gho_", "ghu_", "ghs_", "AKIA", "ASIA", "AIza", "xoxb-", "xoxp-", "xoxa-", "eyJ", "-----BEGIN RSA PRIVATE KEY-----"]
SAFE_HTTP_CLIENTS = ["http_client.", "client.", "conn.", "connection."]

#: Methods of a database that take a statement, and the names of arguments that bind values to it.
DATABASE_METHODS = ["query", "query_one?", "query_one", "query_all", "exec", "execute", "scalar"]
BOUND_ARGUMENTS = ["args", "params"]
#: What a relative import's path may lack, in the order in which it is tried, by language.
IMPORT_SUFFIXES = {
    "crystal": (".cr", "/index.cr"),
    "javascript": ("", ".js", "/index.js"),
    "typescript": ("", ".ts", ".tsx", "/index.ts"),
}
