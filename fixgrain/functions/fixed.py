"""Patterns and word lists whose text is part of the data model's definition.

They are kept as plain text and in their defined order, because results depend on both.
"""

# Denoising patterns.
BOILERPLATE = (
    r"critical update required|urgency guidelines|high-urgency|update is (?:strongly )?recommended for all"
    r"|this is a (?:low|medium|high)-urgency release"
)
ID_PATTERN = r"CVE-\d{4}-\d{4,7}|GHSA-[0-9a-z]{4}-[0-9a-z]{4}-[0-9a-z]{4}"
ADVISORY_ID = ID_PATTERN + r"|RUSTSEC-\d{4}-\d{4}"
NOISE_TITLE = (
    r"(?:^|\b)(?:bump |chore\(deps|dependabot|renovate|pin github actions|github actions|codeql|add .*security scan|security scanning"
    r"|security policy|security\.md|code of conduct|\breadme\b|update copyright|update license|documentation update|update docs|docs:|changelog"
    r"|typo in|fix typo|add default security|create security policy)"
)
BARE_CVE_TITLE = r"^\s*CVE-\d{4}-\d{3,7}\s*$"
PLATFORM_NAMED = {
    "geth": r"go.?ethereum",
    "besu": r"\bbesu\b",
    "nethermind": r"\bnethermind\b",
    "erigon": r"\berigon\b",
    "reth": r"paradigm|\brevm\b|reth\b.{0,30}(?:ethereum|execution)",
    "lighthouse": r"\bsigp\b|lighthouse.{0,30}(?:ethereum|beacon|consensus|validator)",
    "lodestar": r"chainsafe|lodestar.{0,30}(?:ethereum|beacon|consensus)",
    "nimbus": r"nimbus.?eth|status.?im",
    "prysm": r"\bprysm\b",
    "teku": r"\bteku\b|consensys",
    "grandine": r"\bgrandine\b",
}
# Signal vocabularies.
STRONG = (
    r"\b(?:vulnerabilit(?:y|ies)|exploit|RCE|remote code exec(?:ution)?|arbitrary code|use.after.free|UAF|double.free|heap (?:overflow|corruption|spray)"
    r"|stack (?:overflow|smash|corruption)|integer (?:overflow|underflow)|buffer overflow|out.of.bounds|OOB|null pointer deref|segfault"
    r"|memory (?:corruption|safety)|unsound(?:ness)?|injection|deserializ|privilege escal|auth(?:entication)? bypass|access control"
    r"|denial.of.service|DoS|OOM|resource exhaustion|consensus (?:failure|split|diverg)|finality (?:reversion|stall)|chain split"
    r"|equivocation|long.range attack|eclipse attack|timing attack|replay attack|validator (?:slashing|key leak)|invalid block accept"
    r"|state (?:divergence|corruption))\b"
)
MODERATE = (
    r"\b(?:panic|crash|hang|deadlock|livelock|race condition|data race|TOCTOU|memory leak|goroutine leak|fd leak|infinite loop|unbounded|amplification"
    r"|reorg|nonce|underflow|assertion|invariant|divergence|malformed|untrusted|security|unsafe|sanitiz|validate|overflow)\b"
)
FIX_IMPACT = (
    r"\b(?:fix|fixes|fixed|prevent|avoid|guard|handle|resolve|correct|patch)\w*\b[^.\n]{0,40}\b(?:crash|panic|segfault|deadlock|hang|freeze|oom"
    r"|out.of.memory|overflow|underflow|data race|race condition|reorg|non.?determin|infinite loop|use.after.free|null (?:pointer|deref))\b"
    r"|\b(?:crash|panic|segfault|deadlock|hang|oom|overflow|underflow|reorg|race condition)\b[^.\n]{0,25}"
    r"\b(?:fix|fixed|prevent|avoid|guard against|resolved|patch)\w*\b"
)
SENSITIVE_AREA = (
    r"\b(?:fork.?choice|state.?transition|epoch.?process|consensus|finality|reorg|slashing|attestation|sync.?committee|blob|kzg|c-kzg|4844|bls|blst|discv5"
    r"|gossipsub|req.?resp|p2p|devp2p|rlpx|evm|opcode|precompile|trie|tx.?pool|mempool|signature|merkle|ssz|rlp|secp256|ecrecover|snap.?sync)\b"
)
RATED = ("critical", "high", "medium", "low")
# Line mining.
SECURITY_LINE = r"\b(security|vuln(erability)?|CVE-\d{4}-\d+|DoS|panic|crash|RCE|memory[ _-]?leak|integer[ _-]?overflow|race[ _-]?condition)\b"
LINE_CHROME = r"^[#\-*>\s]+"
URGENCY_TEMPLATE = (
    r"\b(urgency.{0,30}guidelines|critical update required|high-urgency|low-urgency|medium-urgency|urgency-level)\b"
)
DEPENDENCY_TITLE = (
    r"upgrade|update|bump|dependab|netty|log4j|spring|jackson|guava|protobuf|golang\.org/x|rustsec|jsonparser|libp2p|discv5|openssl|zlib|\bcrate\b"
)
DEPENDENCY_URL = r"CHANGELOG|/releases/|nvd\.nist\.gov|rustsec"
SKIPPED_SUBJECT = (
    r"^(params: (?:release|begin)|version:|build:|ci:|Merge branch .*release|.*\bPPA\b|chore(?:\(release\))?: release|Prepare(?: for)? release)"
)
SOURCE_FILE = r"\.(go|rs|java|nim|ts|js|py|c|cpp|h|sol)\b"
PATH_HINTS = (
    "fork_choice", "fork choice", "state_transition", "epoch_processing", "bls", "kzg", "discv5", "p2p", "req_resp", "gossipsub", "evm", "precompile",
    "opcode", "trie", "tx_pool", "txpool", "consensus", "finality", "reorg", "slashing", "crypto", "signature", "merkle", "ssz",
)
PLATFORM_ALIASES = {
    "geth": ("geth", "go-ethereum"),
    "nethermind": ("nethermind",),
    "besu": ("besu", "hyperledger"),
    "erigon": ("erigon",),
    "reth": ("reth",),
    "lighthouse": ("lighthouse", "sigp"),
    "lodestar": ("lodestar", "chainsafe"),
    "nimbus": ("nimbus",),
    "prysm": ("prysm", "prysmatic"),
    "teku": ("teku", "consensys"),
    "grandine": ("grandine",),
}
CONSENSUS_PLATFORMS = ("lighthouse", "lodestar", "nimbus", "prysm", "teku", "grandine")
# Root causes and triggers, first match wins.
ROOT_CAUSES = (
    (r"out.of.bounds|bounds check|index out|slice bounds|oob\b", "missing_bounds_check"),
    (r"overflow|underflow|wrapping", "integer_overflow_underflow"),
    (r"nil pointer|null pointer|nil deref|npe|unwrap|nil map|none type", "unhandled_error_or_nil"),
    (r"validat|verify|sanitiz|malformed|invalid input|check that", "missing_input_validation"),
    (r"gas|refund|out of gas|gas cost", "incorrect_gas_accounting"),
    (r"consensus|divergen|chain split|invalid block|non.?determin|fork", "consensus_divergence"),
    (r"oom|out of memory|unbounded|exhaust|memory leak|resource|dos|denial", "resource_exhaustion"),
    (r"race|toctou|concurren|deadlock|data race", "race_condition"),
    (r"deserial|serializ|decode|ssz|rlp", "serialization_bug"),
    (r"state|storage|trie|balance|corrupt", "improper_state_update"),
    (r"signature|crypto|kzg|bls|curve|point", "crypto_misuse"),
    (r"reentran", "reentrancy"),
)
CLASS_CAUSES = {
    "dos": "resource_exhaustion", "memory": "missing_bounds_check", "overflow": "integer_overflow_underflow",
    "consensus": "consensus_divergence", "validation": "missing_input_validation", "auth": "missing_input_validation",
}
ATTACK_PATHS = (
    (r"malicious (?:block|payload)|invalid block|crafted block", "malicious_block"),
    (r"malicious (?:tx|transaction)|crafted (?:tx|transaction)", "malicious_tx"),
    (r"attestation|attester", "malicious_attestation"),
    (r"p2p|gossip|peer message|network message|req.?resp|rpc request", "malicious_p2p_message"),
    (r"malformed|invalid input|crafted input|bad input|parse", "malformed_input"),
    (r"crafted state|state|database", "crafted_state"),
    (r"large|oversized|huge|unbounded", "large_input"),
    (r"\bpeer\b|connection", "peer"),
)
# Areas, first match wins: one list by layer, then the common list.
CONSENSUS_AREAS = (
    (r"das[-_/]|data[-_]?column|peer[-_]?das|column[-_]?sidecar|sampling", "data-availability-sampling"),
    (r"kzg|blob[-_]?sidecar|polynomial[-_]?commit|4844|c-kzg", "kzg-commitments"),
    (
        r"\bepbs\b|payload[-_]?attestation|builder[-_]?(?:bid|api|payload)|blinded[-_]?(?:block|beacon)|mev[-_]?boost|\bptc\b|execution[-_]?payload[-_]?envelope",
        "builder",
    ),
    (r"light[-_]?client", "light-client"),
    (r"weak[-_]?subjectivity", "weak-subjectivity"),
    (r"deposit[-_]?contract", "deposit-contract"),
    (r"fork[-_]?choice|forkchoice|on_block|proposer[-_]?boost|lmd|ghost", "fork-choice"),
    (r"sync[-_]?committee|synccommittee", "beacon-chain:sync-committee"),
    (r"execution[-_]?payload|execpayload|process_execution", "beacon-chain:execution-payload"),
    (r"attest", "beacon-chain:attestation"),
    (r"slash", "beacon-chain:slashing"),
    (r"withdraw|bls[-_]?to[-_]?execution|bls_change", "beacon-chain:withdrawal"),
    (r"voluntary[-_]?exit|consolidat|\bexit\b", "beacon-chain:exit-consolidation"),
    (r"\bdeposit", "beacon-chain:deposit"),
    (r"justif|finali[sz]ation|\bffg\b|process_justif", "beacon-chain:justification-and-finality"),
    (r"rewards?[-_]?and[-_]?penal|\breward|penalt|inactivity", "beacon-chain:rewards-and-penalties"),
    (r"registry[-_]?update|activation[-_]?queue|exit[-_]?queue|\bchurn|activation_eligibility", "beacon-chain:registry-updates"),
    (r"effective[-_]?balance", "beacon-chain:effective-balance-updates"),
    (
        r"epoch[-_]?process|process_epoch|historical_summar|historical_root|participation_flag|randao_mix|slashings_reset|eth1_data_reset",
        "beacon-chain:epoch-processing",
    ),
    (r"block[-_]?process|process_block|block_header|randao|eth1[-_]?data", "beacon-chain:block-processing"),
    (r"gossip|req[-_]?resp|reqresp|discv5|/enr|network|/p2p|libp2p", "p2p-interface"),
    (r"\bbls\b|signature[-_]?verif", "bls"),
    (r"/fork\b|fork\.py|upgrade_to|state_upgrade", "fork-transition"),
    (r"validator|duties|proposer|attester", "validator"),
    (r"beacon[-_]?chain|state[-_]?transition|beaconstate", "beacon-chain:block-processing"),
)
EXECUTION_AREAS = (
    (r"precompil", "precompiles"),
    (r"instruction|opcode|/ops?/", "opcodes"),
    (r"eof\b|evm[-_]?object", "eof"),
    (r"blob[-_]?pool|blobpool|4844|blob[-_]?tx", "blobs"),
    (r"engine[-_]?api|newpayload|forkchoiceupdated|getpayload|payload[-_]?builder", "engine-api"),
    (r"txpool|tx[-_]?pool|mempool|legacypool", "txpool"),
    (r"downloader|snap[-_]?sync|/sync|beacon[-_]?sync|skeleton", "sync"),
    (r"\brpc\b|jsonrpc|json[-_]?rpc|/rpc/|eth_api|web3", "rpc"),
    (r"\bgas\b|gaspool|eip[-_]?1559|fee[-_]?market|basefee", "gas"),
    (r"/vm/|/evm|interpreter|opcodes", "evm"),
    (r"transaction|/tx\b|signer|/types/tx", "transactions"),
    (r"\btrie\b|mpt|patricia|/state|stateobject|snapshot|storage", "state-trie"),
    (r"\brlp\b", "rlp"),
    (r"devp2p|/p2p|discover|/eth/protocol|/eth/handler|snap[-_]?protocol|wire", "p2p"),
    (r"block[-_]?process|/core/blockchain|verifyheader|process(?:block|_block)|state_transition", "block-processing"),
)
COMMON_AREAS = (
    (r"crypto|secp256|ecrecover|keccak|\bhash\b|blst|bn256|bls12|schnorr", "crypto"),
    (r"\bssz\b|serial|encode|decode|marshal|unmarshal|codec", "serialization"),
    (r"leveldb|rocksdb|pebble|/db\b|database|/ethdb|/storage/kv", "database"),
    (
        r"\.github|\.circleci|dockerfile|docker-compose|\.gradle\b|gradle/|makefile\b|/build/|verification-metadata|renovate|/vendor/|docs/vulnerab|go\.mod\b"
        r"|go\.sum|package-lock|yarn\.lock|Cargo\.(?:toml|lock)|\.ya?ml\b",
        "build-ci",
    ),
    (r"metric|diagnostic|prometheus|grafana|observ|telemetr|tracing|\botel\b", "metrics-observability"),
    (r"\bcmd/|/cli/|main\.(?:go|rs)\b|BesuCommand|/flags?/|command\.java", "cli"),
    (r"_test\.(?:go|rs|py|ts|js)|/tests?/|testhelper|mock_|spec\.(?:ts|js)|\bfuzz", "test"),
)
# ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# What makes an evaluation item.
FIX_TITLE = (
    r"\b(?:fix|fixes|fixed|prevent|guard|avoid|patch|resolve)\w*\b[^.\n]{0,45}\b(?:crash|panic|segfault|deadlock|hang|oom|out.of.memory|overflow"
    r"|underflow|use.after.free|nil (?:pointer|deref)|null (?:pointer|deref)|data race|race condition|reorg|consensus|invalid block|dos"
    r"|denial.of.service|memory leak|infinite loop|out.of.bounds)\b"
)
FEATURE_TITLE = r"\b(?:feat|feature|refactor|perf|rename|cleanup|clean up|implement|add support|introduce|improve|optimi[sz]e|simplify|migrate|style|move)\b"
BUMP_TITLE = r"\bbump\b|chore\(deps|dependabot|renovate"
UNCLEAN_TITLE = r"^\s*(?:vendor|revert|ci)\b|vendored|third.party|\btest(?:s|ing)?\b|\bsim\b|simulator|evmtool|\binspect\b|pprof|\bflak"
ITEM_ID = r"CVE-\d{4}-\d{4,7}|GHSA-"
CHANGE_URL = r"/pull/|/commit/"
SUBSYSTEM = (
    r"fork.?choice|state.?transition|epoch|consensus|finality|reorg|slashing|attestation|sync.?committee|blob|kzg|bls|discv5|gossip|p2p|rlpx|evm"
    r"|opcode|precompile|trie|tx.?pool|mempool|signature|merkle|ssz|rlp|secp256"
)
# Captures.
SECURITY_TITLE = r"\b(?:security|vuln(?:erability)?|CVE-\d{4}-\d+|DoS|panic|crash|RCE|memory\s+leak|integer\s+overflow|race\s+condition)\b"
SPLIT_TEXT = r"client\s+divergence|consensus\s+divergence|consensus\s+split|implementation\s+divergence"
INLINE_PULL = r"/pull/(\d+)|\(#(\d+)\)|\[#?(\d{2,})\]|(?:^|\s)#(\d{2,})\b"
# Domains of answers.
STRIDE = ("Spoofing", "Tampering", "Repudiation", "Information Disclosure", "Denial of Service", "Elevation of Privilege", "Other")
CWE_TOP = (
    "CWE-79", "CWE-787", "CWE-89", "CWE-352", "CWE-22", "CWE-125", "CWE-78", "CWE-416", "CWE-862", "CWE-434", "CWE-94", "CWE-20", "CWE-77",
    "CWE-287", "CWE-269", "CWE-502", "CWE-200", "CWE-863", "CWE-918", "CWE-119", "CWE-476", "CWE-798", "CWE-190", "CWE-400", "CWE-306",
)
# Profiles.
LANGUAGES = {
    "geth": "Go", "erigon": "Go", "prysm": "Go", "nethermind": "C#", "besu": "Java", "teku": "Java",
    "reth": "Rust", "lighthouse": "Rust", "grandine": "Rust", "nimbus": "Nim", "lodestar": "TypeScript",
}
CHANNELS = {
    "malicious_p2p_message": "network: p2p / gossip", "malicious_attestation": "network: p2p / gossip", "peer": "network: p2p / gossip",
    "malicious_block": "network: block gossip", "malicious_tx": "on-chain: transaction / EVM", "malformed_input": "parsing untrusted input",
    "large_input": "parsing untrusted input", "crafted_state": "crafted chain state", "internal_only": "internal (not attacker-reachable)",
}
CHANNEL_ORDER = (
    "network: p2p / gossip", "network: block gossip", "on-chain: transaction / EVM", "parsing untrusted input", "crafted chain state",
    "internal (not attacker-reachable)",
)
VALUE_AREAS = ("evm", "opcodes", "precompiles", "fork-choice", "transactions", "crypto", "kzg-commitments", "serialization", "state-trie")
AVAILABILITY_AREAS = ("p2p", "p2p-interface", "sync", "rpc", "txpool", "database", "engine-api")
SIZE_BINS = (0, 5, 10, 20, 30, 50, 100, 200, 500, 5000)
