"""Word lists, prefixes and patterns that the classifiers start from. Every function takes its lexicon as a parameter."""

from __future__ import annotations

from dataclasses import dataclass, replace

# ---- fixed values ---------------------------------------------------------------------------

#: Tokens: runs of letters, digits and underscores of two or more, with ' and - inside.
TOKEN = r"[\p{L}\p{N}_][\p{L}\p{N}_'-]*[\p{L}\p{N}_]"

APPROVAL = tuple("proceed continue yes go ok okay sounds great perfect ship merge do 👍".split())
PUSHBACK = tuple("stop wait no don't dont actually but however hold pause revert rollback".split())

SLASH_COMMANDS = tuple(
    "/agents /clear /compact /cost /doctor /flow /frontend-design /help /init /memory /model /permissions /plugin /plugins /review /ship /skills /status".split()
)

#: Function words by language.
STOPWORDS = {
    "english": tuple(
        "the a an is it and or but of to in on at for with as by from this that these those i you he she we they be are was "
        "were been being have has had do does did if then than so not no yes can could would should will shall may might must "
        "let lets me my your our their his her its any all some what when where why how which who whom there here now also "
        "just only too very much many".split()
    ),
    "norwegian": tuple(
        "og i jeg det at en et den til er som på de med han av ikke ikkje der så var meg seg men ett har om vi min mitt mine "
        "deg kan kunne skulle ville blir ble være bli ha".split()
    ),
    "german": tuple(
        "und der die das den dem ein eine einer ich du er sie es wir ihr ist sind war waren haben hat habe auf aus bei mit "
        "nach von zu für über unter wenn dann aber oder nicht kein".split()
    ),
    "spanish": tuple(
        "el la los las un una unos unas y o pero que porque como cuando donde si no ser estar tener hacer ir me te se nos os lo le".split()
    ),
    "french": tuple(
        "le la les un une des et ou mais donc or ni car que qui ce cet cette ces mon ton son notre votre leur je tu il elle "
        "nous vous ils elles est sont était étaient".split()
    ),
}

LANGUAGE_MARKERS = {
    "norwegian": "jeg|ikke|ikkje|også|på|hvor|nå|fordi|skal|kanskje|hvorfor|hva",
    "german": "nicht|auch|aber|sind|wäre|würde|möchte|über|für|nach|gegen",
    "spanish": "porque|también|cuando|donde|hacer|tener|estar|pero|hola|gracias",
    "french": "pourquoi|aussi|mais|sont|peut|faire|avoir|être|merci|bonjour",
    "portuguese": "obrigado|também|porque|quando|onde|fazer|ter|estar|mas|olá",
}

DISSATISFACTION = (
    "but|however|actually|instead|rather than|why didn'?t|you didn'?t|missing|forgot|incorrect|wrong|not (?:what|quite)|"
    "hmm|that'?s not|undo|revert|let'?s try|too (?:verbose|much|long)|isn'?t (?:right|correct)|won'?t work"
)

CORPUS_WAKE_PREFIXES = ("-\n## Paperclip", "## Paperclip", "Paperclip Wake Payload", "<<autonomous", "You are agent", "<<autonomous-loop", "<<autonomous-loop-dynamic>>")
MINING_WAKE_PREFIXES = CORPUS_WAKE_PREFIXES[:5]
DETECTOR_WAKE_PREFIXES = (
    *CORPUS_WAKE_PREFIXES[:5],
    "You are a ", "<<autonomous-loop", "<<autonomous-loop-dynamic>>", "<system-reminder>", "<command-name>",
    "Task Notification", "task notification", "<task-notification>", "<task-id>", "<tool-use-id>",
    "This session is being continued", "<local-command-", "[Request interrupted", "Caveat: The messages below",
)

SOUNDS_APPROVAL = r"(?i)^[\s\p{Z}]*sounds[\s\p{Z}]+(?:good|right|fine|great|reasonable|like a plan)(?:[^\p{L}\p{N}_]|$)"

DESTRUCTIVE = (
    "force-push", "force push", "publish", "release", "delete", " rm ", "rm -", "drop ", "truncate",
    "deploy to prod", "deploy-to-prod", "merge to main", "merge into main",
)

# ---- variants -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Lexicon:
    """What one classifier counts as approval, pushback, dissatisfaction and automated text."""

    approval: tuple[str, ...] = APPROVAL
    pushback: tuple[str, ...] = PUSHBACK
    markers: str = DISSATISFACTION
    wake_prefixes: tuple[str, ...] = CORPUS_WAKE_PREFIXES


QUANTITATIVE = Lexicon()
TEMPORAL = replace(QUANTITATIVE, approval=tuple(w for w in APPROVAL if w not in ("do", "👍")))
MINING = replace(QUANTITATIVE, approval=(*APPROVAL, "lgtm", "approved"), pushback=(*PUSHBACK, "halt", "abort"), wake_prefixes=MINING_WAKE_PREFIXES)
DETECTOR = replace(
    MINING, approval=tuple(w for w in MINING.approval if w not in ("sounds", "👍")), wake_prefixes=DETECTOR_WAKE_PREFIXES
)

#: Frequent words of the driver's invented prose, so that every branch is taken there.
BENCH = Lexicon(approval=("the", "to", "in", "die", "la"), pushback=("of", "der", "and", "le"), markers="and|und|et|que", wake_prefixes=("The ", "Der "))


def whole_word(alternatives: str) -> str:
    """A pattern for any of the alternatives as whole words, in a form that engines without look-around share."""
    return rf"(?i)(^|[^\p{{L}}\p{{N}}_])({alternatives})([^\p{{L}}\p{{N}}_]|$)"
