"""Fixed schemas of the archive."""

TURN = """struct<role:string, body:string, timestamp:timestamp, reasoning:string,
  toolCalls:array<struct<name:string,input:string,output:string>>,
  attachments:array<struct<name:string,kind:string,byteSize:bigint,url:string,inline:boolean>>, format:string>"""
CONFIDENCE = "struct<score:double,complete:boolean,strategy:string,warnings:array<string>>"
CONVERSATION = f"conv_id string, title string, source string, model string, url string, turns array<{TURN}>, extractedAt timestamp, confidence {CONFIDENCE}"
DOCUMENTS = """path string, title string, platform string, model string, url string, fingerprint string, turn_count int,
  content_hash string, mtime double, byte_size bigint, incomplete boolean, indexed_at double"""
MESSAGES = "path string, turn int, role string, body string"
TAGS = "path string, tag string"
REQUEST = f"version int, id string, action string, conversation struct<{', '.join(f.replace(' ', ':', 1) for f in ('title string', 'source string', 'model string', 'url string'))}, turns:array<{TURN}>>, destination string, behaviour string, preset string, query string"
