"""Fixed values of the question and answer rules: word lists and patterns.

A ``Rules`` holds them; names of one's own company, its people, sites and packages are parameters that default to nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values of the surveyed rules, in their order.
STOP = (
    "the", "a", "an", "is", "are", "do", "does", "did", "to", "of", "in", "for", "on", "and", "or", "if", "i", "you", "we", "my", "your", "me",
    "it", "this", "that", "be", "can", "could", "would", "will", "have", "has", "with", "what", "when", "how", "where", "which", "there", "any",
    "so", "as", "at", "by", "from", "but", "not", "they", "he", "she", "please", "thank", "thanks", "dear", "hi", "hello", "am", "was", "were",
)
GENERIC = ("visa", "residence", "permit", "trp", "prp", "shared", "values", "russia", "relocation", "relocate", "process", "program", "application", "temporary", "permanent", "golden", "move", "moving")
TOPICS = (
    "visa", "residence", "permit", "trp", "prp", "citizenship", "passport", "document", "apostille", "criminal", "registration", "migration",
    "payment", "fee", "cost", "price", "invoice", "retainer", "deposit", "wire", "transfer", "bank", "broker", "investment", "golden",
    "shared", "values", "relocate", "relocation", "russia", "moscow", "family", "spouse", "children", "timeline", "process", "step",
    "hotel", "flight", "insurance", "medical", "language", "work", "job", "tax", "fbi", "translation", "contract", "agreement",
    "eligibility", "permanent", "temporary", "tourist", "entry",
)
GENERIC_QUESTION = (
    r"^anything else(?: i need to know| i should know)?\??$", r"^is there anything else\b", r"^outside of .+ anything else\b", r"^anything else i'?m forgetting\b",
    r"^please let me know if it'?s you need anything else\b", r"^are you able to tell me more about this\??$", r"^could you tell me more\b",
    r"^tell me more about this\??$", r"^is that (?:correct|accurate|right)\??$", r"^does that (?:make sense|work)\??$", r"^you will call via\b",
    r"^work on your end\??$", r"^perhaps this take place\b", r"^can we please schedule a call\b", r"^would you be available\b", r"^eastern time work\b",
    r"^what is .+'s phone number\b", r"^and also what is\b", r"^number two, what kind of timeline\b", r"^have a (?:wonderful|great|nice)\b",
    r"^thank you\b", r"^correct\??$",
)
TEMPLATE_QUESTION = (
    r"what is your (?:potential )?desired timeline", r"are you in the exploration", r"have you already decided to relocate", r"have you previously visited russia",
    r"do you only need assistance with the relocation", r"how many family members plan to move", r"could you kindly provide a scan of your passport",
    r"could you share a bit more (?:about )?your situation", r"looking forward to your reply", r"please let us know your availability",
)
MANAGER_QUESTION = (
    r"could you (?:please )?share a bit more about your situation", r"what kind of timeline are you envisioning", r"are you primarily looking for assistance",
    r"plan to relocate to Russia and are seeking", r"could you tell us a bit more about your family", r"are you in the exploratory stage",
    r"have you already decided to move to Russia", r"could you kindly share a phone number", r"would you like to explore options",
    r"are you planning to relocate alone or with your family", r"^\*?\s*are you planning to relocate\b", r"is that correct\??$",
)
MANAGER_ASKS = (
    r"could you kindly give me access", r"when you have a moment, could you kindly", r"please find below answers to your questions",
    r"to provide you with the best possible guidance", r"to ensure we provide you with the most relevant information",
    r"could you tell us a little more about your situation", r"could you kindly share a bit more information about your situation",
    r"suggested next step\b", r"thank you kindly for answering the questions",
)
NOISE_QUESTION = (
    r"^could you please correct", r"^is that correct\??", r"^is the accurate\??", r"^correct\??", r"^dear ", r"^thank you", r"^thanks ", r"^hi ", r"^hello ",
    r"^have a (?:wonderful|great|nice) ", r"^wishing you", r"^any updates will", r"^if you don'?t want to receive", r"^\.{3,}", r"^;\s*\d{2}\.\d{2}\.\d{4}",
)
SCHEDULING = (
    r"work for you(?: for the|\b)", r"time slot", r"available for (?:a )?(?:call|onboarding)", r"onboarding call", r"schedule a call",
    r"would (?:Thursday|Tuesday|Monday|Wednesday|Friday)", r"\d{1,2}:\d{2}\s*(?:AM|PM|am|pm)", r"(?:UK|Moscow|Tbilisi|Ireland) time", r"join a meeting from my side",
)
REJECTED = (
    r"^https?://", r"^Hello,\s", r"^Would you like to\b", r"^\-\s*Are you planning to relocate\b", r"\banything else i'?m forgetting\b", r"\bdo i need to do anything else\b",
    r"\[cid:", r"@\w+\.(?:com|ru)", r"kind regards", r"client relationship manager",
)
REJECTED_EXACT = (r"\bDear\s+[A-Z]", r"^\d+(?:st|nd|rd|th)?\s+[A-Z][a-z]+\s+\d{4}\b", r"^[A-Z][a-z]+(?:,\s|\s+to ensure|\s+I am thinking|\s+could you kindly)")
HEADER_FRAGMENT = (r"@\w+\.(?:com|ru|gmail|yandex)", r"\d{2}\.\d{2}\.\d{4},\s*\d{2}:\d{2}", r"thank you kindly for your inquiry")
PACKAGE_QUESTION = (r"\b(?:cost|price|fee|pricing|retainer|how much)\b", r"full[- ]service (?:package|relocation)", r"what specific support is included", r"support package", r"company cost", r"price for your support")
CALL_ONLY = (
    r"^please let us know your availability", r"^would you be available for a (?:brief )?call", r"^as a next step, may i suggest we schedule a call",
    r"^if this service interests you, please feel free to contact us", r"^sent to you an invite for",
)
BOILERPLATE = (
    r"^hope you(?:'re| are) having a (?:wonderful|great|nice)", r"^i hope this (?:message|email) finds you", r"^looking forward to (?:hearing from you|your reply)",
    r"^please (?:let me know|don't hesitate)", r"^we are looking forward to support you", r"^understood\.?\s*it'?s wonderful", r"^apologies for my delayed response",
)
ANSWER_NOISE = (r"^To:\s", r"^Subject:", r"^CC:", r"^Bcc:", r"Beginning of forwarded message", r"@\w+\.(?:com|ru|yandex|gmail)", r"Client relationship manager", r"@\w+\s*<")
SIGN_OFF = (r"(?:^|\n)--+\s*\n", r"(?:^|\n)Kind regards", r"(?:^|\n)Warm regards", r"(?:^|\n)Best regards", r"(?:^|\n)Client relationship manager")
GREETING = r"^(?:Dear|Hi|Hello|Good (?:morning|afternoon|evening)|Greetings)\s+(?:Mr\.|Ms\.|Mrs\.|Miss|Dr\.)?\s*[^,\n]{1,60},\s*"
HONORIFIC = r"\b(?:Mr\.|Ms\.|Mrs\.|Miss|Dr\.)\s+[A-Z][A-Za-z\-']+(?:\s+[A-Z][A-Za-z\-']+)?\b"
THANKS_OPENING = r"^(?:Thank you(?: kindly)?(?: for your (?:reply|message|email|inquiry))?[^.!?]*[.!?]\s*)+"
CLIENT_VOICE = (r"^I prefer to", r"^I would like to", r"^I was wanting", r"^Thank you very much", r"^I am curious", r"^I thought ", r"^I shared the", r"^According to my latest")
ASKED_AND_ANSWERED = r"\?\s+(?:Yes|No|Absolutely|Certainly|The |You |We |It |This |Regarding |Currently )"


@dataclass(frozen=True)
class Rules:
    """Word lists of the rules; own is patterns of one's own sites and names, names people's, package patterns of an answer that offers a package."""

    stop: tuple[str, ...] = STOP
    generic: tuple[str, ...] = GENERIC
    topics: tuple[str, ...] = TOPICS
    own: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    package: tuple[str, ...] = (r"Full-Service Support Package", r"success rate is 100%")


def any_of(patterns: tuple[str, ...], flags: str = "i") -> str:
    """One pattern of several; it matches nothing where there are none."""
    joined = "|".join(f"(?:{p})" for p in patterns) or r"[^\s\S]"
    return f"(?{flags})(?:{joined})" if flags else f"(?:{joined})"
