"""Row-parallel detectors over text: line rules, infrastructure rules, and secrets. Nothing here shuffles."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions.regex import any_of, ascii_words
from sievelight.schema import RANKS, as_findings

INJECTION, CRYPTO, CONFIG = "A03:2021 Injection", "A02:2021 Cryptographic Failures", "A05:2021 Security Misconfiguration"
AUTH, INTEGRITY = "A07:2021 Identification and Authentication Failures", "A08:2021 Software and Data Integrity Failures"


class Rule(NamedTuple):
    id: str
    title: str
    description: str
    severity: str
    owasp: str
    pattern: str


#: Rules that a line is tested by, case-insensitive, with ASCII word boundaries.
LINE_RULES = [
    Rule("exec-os-system", "Command Execution", "Potential command execution via system call.", "critical", INJECTION,
         r"\b(os\.system|subprocess\.(call|run|Popen)|Runtime\.getRuntime\(\)\.exec|ProcessBuilder|exec\.Command|system\s*\(|popen\s*\(|Process\.Start|ShellExecute)\b"),
    Rule("eval-exec", "Dynamic Code Execution", "Potential dynamic code execution detected.", "high", INJECTION,
         r"\b(eval|exec|Function|vm\.runInThisContext|loadstring)\s*\("),
    Rule("unsafe-deserialization", "Unsafe Deserialization", "Potential unsafe deserialization API usage.", "high", INTEGRITY,
         r"\b(pickle\.loads?|yaml\.load|YAML\.load|ObjectInputStream|BinaryFormatter|XmlSerializer|Marshal\.load|PHP\s*unserialize|unserialize\s*\()\b"),
    Rule("weak-crypto", "Weak Crypto", "Use of weak or deprecated crypto primitives.", "medium", CRYPTO,
         r"\b(MD5|SHA1|RC4|DES|3DES|ECB)\b"),
]

#: Rules over the whole text of infrastructure files, case-insensitive, every match.
INFRA_RULES = [
    Rule("dockerfile-root-user", "Container Runs as Root", "Dockerfile runs as root user; consider using a non-root user.", "medium", CONFIG, r"\bUSER\s+root\b"),
    Rule("dockerfile-privileged", "Privileged Container", "Dockerfile enables privileged mode or sets all capabilities.", "high", CONFIG, r"\b(--privileged|CAP_SYS_ADMIN|cap_add\s*:\s*\[?\s*ALL\s*\]?)"),
    Rule("k8s-privileged", "Privileged Kubernetes Pod", "Kubernetes manifest enables privileged containers.", "high", CONFIG, r"\bprivileged\s*:\s*true\b"),
    Rule("k8s-host-path", "HostPath Volume", "Kubernetes HostPath volume may allow host access.", "medium", CONFIG, r"\bhostPath\s*:\b"),
    Rule("k8s-host-network", "Host Network Enabled", "Kubernetes manifest enables hostNetwork which reduces isolation.", "medium", CONFIG, r"\bhostNetwork\s*:\s*true\b"),
    Rule("k8s-host-ipc", "Host IPC Enabled", "Kubernetes manifest enables hostIPC which reduces isolation.", "medium", CONFIG, r"\bhostIPC\s*:\s*true\b"),
    Rule("k8s-host-pid", "Host PID Namespace", "Kubernetes manifest enables hostPID which reduces isolation.", "medium", CONFIG, r"\bhostPID\s*:\s*true\b"),
    Rule("k8s-allow-priv-esc", "Privilege Escalation Enabled", "Kubernetes manifest allows privilege escalation.", "high", CONFIG, r"\ballowPrivilegeEscalation\s*:\s*true\b"),
    Rule("k8s-no-readonly-fs", "Writable Root Filesystem", "Kubernetes manifest allows writable root filesystem.", "medium", CONFIG, r"\breadOnlyRootFilesystem\s*:\s*false\b"),
    Rule("k8s-run-as-root", "Container Runs as Root", "Kubernetes securityContext allows root user.", "medium", CONFIG, r"\brunAsNonRoot\s*:\s*false\b"),
    Rule("k8s-run-as-user-root", "Container Runs as Root UID", "Kubernetes manifest sets runAsUser to 0 (root).", "medium", CONFIG, r"\brunAsUser\s*:\s*0\b"),
    Rule("k8s-seccomp-unconfined", "Seccomp Unconfined", "Kubernetes manifest disables seccomp confinement.", "high", CONFIG, r"\bseccompProfile\b[\s\S]*?\btype\s*:\s*Unconfined\b"),
    Rule("terraform-public-sg", "Public Security Group", "Terraform security group allows ingress from all sources.", "high", CONFIG, r'\b(cidr_blocks|cidr_block)\s*=\s*\[?\s*"0\.0\.0\.0/0"\s*\]?'),
    Rule("terraform-public-acl", "Public Network ACL", "Terraform network ACL allows ingress from all sources.", "high", CONFIG, r"\b(ingress|egress)\b[\s\S]*0\.0\.0\.0/0"),
    Rule("terraform-open-sg-port", "Open Security Group Port", "Terraform security group allows public ingress on common ports.", "high", CONFIG, r"\b(from_port|to_port)\s*=\s*(22|3389|5432|3306|6379|9200|27017)\b[\s\S]*0\.0\.0\.0/0"),
    Rule("terraform-public-s3-acl", "Public S3 ACL", "Terraform S3 ACL is public-read or public-read-write.", "high", CONFIG, r'\bacl\s*=\s*"public-read(-write)?"'),
    Rule("terraform-s3-public-block-disabled", "S3 Public Access Block Disabled", "Terraform disables S3 public access block.", "high", CONFIG, r"\b(block_public_acls|block_public_policy|ignore_public_acls|restrict_public_buckets)\s*=\s*false\b"),
    Rule("terraform-rds-public", "Public RDS Instance", "Terraform RDS instance is publicly accessible.", "high", CONFIG, r"\bpublicly_accessible\s*=\s*true\b"),
    Rule("yaml-insecure-tls", "Insecure TLS", "Config disables TLS verification.", "medium", CRYPTO, r"\b(insecureSkipVerify|ssl_verify\s*:\s*false|verify_ssl\s*:\s*false)\b"),
]

#: Forms of secret values, in the order in which they are tried, case-sensitive.
SECRET_VALUES = [
    ("secret-aws-access-key", "Hardcoded AWS Access Key", r"AKIA[0-9A-Z]{16}"),
    ("secret-github", "Hardcoded GitHub Token", r"gh[pousr]_[A-Za-z0-9]{20,}"),
    ("secret-slack", "Hardcoded Slack Token", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    ("secret-stripe", "Hardcoded Stripe Secret Key", r"sk_live_[A-Za-z0-9]{16,}"),
    ("secret-google-api", "Hardcoded Google API Key", r"AIza[0-9A-Za-z\-_]{35}"),
    ("secret-jwt", "Hardcoded JWT", r"eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}"),
    ("secret-private-key", "Hardcoded Private Key", r"-----BEGIN (RSA|EC|DSA|PRIVATE) KEY-----"),
]
SECRET_NAME = r"(?i)^(api[-_]?key|secret|token|password|passwd|pwd|private[-_]?key|access[-_]?key|client[-_]?secret)$"
SECRET_MIN_LENGTH, SECRET_MIN_ENTROPY = 16, 3.7

#: Name or key, then a quoted literal; template literals count if nothing is put into them.
ASSIGNED = r"""([A-Za-z_$][A-Za-z0-9_$-]*)["']?\s*[:=]\s*("[^"\n]*"|'[^'\n]*'|`[^`$\n]*`)"""


def java(rule: Rule) -> str:
    return "(?i)" + ascii_words(rule.pattern)


def _tagged(description: Column, owasp: Column) -> Column:
    """Descriptions name their category at the end."""
    return F.concat(description, F.lit(" ["), owasp, F.lit("]"))


def _rule_struct(rule: Rule, no: int) -> Column:
    return F.struct(F.lit(no).alias("no"), *[F.lit(v).alias(k) for k, v in zip(("id", "title", "description", "severity", "owasp"), rule)])


def lines_of(content: Column) -> Column:
    return F.split(content, r"\r?\n", -1)


def line_patterns(files: DataFrame, rules: list[Rule] = LINE_RULES) -> DataFrame:
    """At most one finding per rule and line. Lines that no rule matches are dropped before they become rows."""
    any_rule = F.lit(any_of([r.pattern for r in rules]))
    numbered = F.transform(lines_of(F.col("content")), lambda text, i: F.struct((i + 1).cast("int").alias("line"), text.alias("text")))
    hits = files.filter(F.rlike("content", any_rule)).select("repo", "file", F.explode(F.filter(numbered, lambda x: F.rlike(x["text"], any_rule))).alias("l"))
    tested = F.filter(F.array(*[F.when(F.rlike("l.text", F.lit(java(r))), _rule_struct(r, no)) for no, r in enumerate(rules)]), lambda r: r.isNotNull())
    rows = hits.select("repo", "file", "l.line", F.explode(tested).alias("r"))
    found = rows.select(
        "repo", "file", "line", "r.id", "r.severity", "r.title", _tagged(F.col("r.description"), F.col("r.owasp")).alias("description"), "r.owasp",
        F.lit("code").alias("category"), F.lit(RANKS["line"]).alias("detector_rank"), (F.col("line").cast("long") * len(rules) + F.col("r.no")).alias("seq"),
    )
    return as_findings(found)


def match_lines(text: Column, pattern: str) -> Column:
    """Line of each match: one more than the newlines in all pieces up to it and in the matches before it."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # Bytes are counted: translate() looks up each character of the text, once for each rule.
    newlines = lambda s: F.octet_length(s) - F.octet_length(F.replace(s, F.lit("\n"), F.lit("")))
    pairs = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(newlines(p).alias("p"), newlines(m).alias("m")))
    begin = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("lines"))

    def step(acc, x):
        line = acc["at"] + x["p"]
        return F.struct((line + x["m"]).alias("at"), F.array_append(acc["lines"], line).alias("lines"))

    return F.aggregate(pairs, begin, step)["lines"]


def _keyword(rule: Rule) -> str:
    """What a match of the rule begins with: the pattern up to the first run over any text."""
    return rule.pattern.split(r"[\s\S]*")[0]


def infra_patterns(files: DataFrame, rules: list[Rule] = INFRA_RULES, only_infra: bool = True) -> DataFrame:
    """One finding per match of a rule in the whole text, at the line where the match begins."""
    from sievelight.functions.paths import is_infra_file

    rows = files.filter(is_infra_file(F.col("file"))) if only_infra else files
    none = F.array().cast("array<int>")
    # One pass tells files that no rule matches; a rule that ends far behind its keyword is tried only where its end stands.
    rows = rows.filter(F.rlike("content", F.lit(any_of([_keyword(r) for r in rules]))))

    def worth(r: Rule) -> Column:
        return F.contains("content", F.lit("0.0.0.0/0")) if r.pattern.endswith(r"[\s\S]*0\.0\.0\.0/0") else F.lit(True)

    tested = F.array(*[F.struct(_rule_struct(r, no).alias("r"), F.when(worth(r) & F.rlike("content", F.lit(java(r))), match_lines(F.col("content"), java(r))).otherwise(none).alias("lines")) for no, r in enumerate(rules)])
    rows = rows.select("repo", "file", F.explode(F.filter(tested, lambda x: F.size(x["lines"]) > 0)).alias("x")).select("repo", "file", "x.r", F.posexplode("x.lines").alias("k", "line"))
    found = rows.select(
        "repo", "file", "line", "r.id", "r.severity", "r.title", _tagged(F.col("r.description"), F.col("r.owasp")).alias("description"), "r.owasp",
        F.lit("code").alias("category"), F.lit(RANKS["infra"]).alias("detector_rank"), (F.col("r.no").cast("long") * (1 << 40) + F.col("k")).alias("seq"),
    )
    return as_findings(found)


def assigned_literals(files: DataFrame) -> DataFrame:
    """repo, file, line, column (of the literal), name, value: names and keys that a quoted literal is given to, by line.

    Lexical: facts from a real parser can take its place. The column is counted from 1 at the opening quote.
    """
    numbered = F.transform(lines_of(F.col("content")), lambda text, i: F.struct((i + 1).cast("int").alias("line"), text.alias("text")))
    lines = files.select("repo", "file", F.explode(F.filter(numbered, lambda x: F.rlike(x["text"], F.lit(ASSIGNED)))).alias("l"))
    pieces, found = F.split(F.col("l.text"), ASSIGNED, -1), F.regexp_extract_all("l.text", F.lit(ASSIGNED), F.lit(0))
    names, quoted = F.regexp_extract_all("l.text", F.lit(ASSIGNED), F.lit(1)), F.regexp_extract_all("l.text", F.lit(ASSIGNED), F.lit(2))
    cells = F.transform(F.sequence(F.lit(0), F.size(found) - 1), lambda i: F.struct(F.get(pieces, i).alias("before"), F.get(found, i).alias("all"), F.get(names, i).alias("name"), F.get(quoted, i).alias("quoted")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<column:int,name:string,value:string>>").alias("out"))

    def step(acc, x):
        end = acc["at"] + F.length(x["before"]) + F.length(x["all"])
        value = F.substr(x["quoted"], F.lit(2), F.length(x["quoted"]) - 2)
        own = F.struct((end - F.length(x["quoted"]) + 1).alias("column"), x["name"].alias("name"), value.alias("value"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], own).alias("out"))

    rows = lines.select("repo", "file", "l.line", F.explode(F.aggregate(cells, begin, step)["out"]).alias("c"))
    return rows.select("repo", "file", "line", "c.column", "c.name", "c.value")


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character; for literals, not for whole files."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.length(text)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.transform(F.array_distinct(chars), lambda c: share(c) * F.log2(share(c))), F.lit(0.0), lambda a, x: a - x)


def secret_value_id(value: Column) -> Column:
    """Rule id of the first form that a literal of enough length has."""
    choice = F.when(F.length(value) < SECRET_MIN_LENGTH, F.lit(None).cast("string"))
    for rule, _, pattern in SECRET_VALUES:
        choice = choice.when(F.rlike(value, F.lit(pattern)), rule)
    return choice


def is_secret_name(name: Column) -> Column:
    return F.rlike(name, F.lit(SECRET_NAME))


def classify_secrets(literals: DataFrame) -> DataFrame:
    """Adds secret_id and reason (value, name, entropy) in that order of precedence; literals that are none of them are dropped."""
    long = F.length("value") >= SECRET_MIN_LENGTH
    rows = literals.withColumn("by_value", secret_value_id(F.col("value")))
    reason = F.when(F.col("by_value").isNotNull(), "value").when(long & is_secret_name(F.col("name")), "name").when(long & (entropy(F.col("value")) >= SECRET_MIN_ENTROPY), "entropy")
    return rows.withColumn("reason", reason).filter("reason is not null").withColumn("secret_id", F.coalesce("by_value", F.lit("hardcoded-secret"))).drop("by_value")


def secret_findings(literals: DataFrame) -> DataFrame:
    """Findings of classify_secrets, with the titles of the forms."""
    title = F.lit("Hardcoded Secret")
    for rule, named, _ in SECRET_VALUES:
        title = F.when(F.col("secret_id") == rule, named).otherwise(title)
    rows = classify_secrets(literals).select(
        "repo", "file", "line", "column", F.col("secret_id").alias("id"), F.lit("high").alias("severity"), title.alias("title"),
        _tagged(F.lit("A literal looks like a secret."), F.lit(AUTH)).alias("description"), F.lit(AUTH).alias("owasp"), F.lit("code").alias("category"),
        F.lit(RANKS["patterns_js"]).alias("detector_rank"), (F.col("line").cast("long") * (1 << 31) + F.col("column")).alias("seq"),
    )
    return as_findings(rows)
