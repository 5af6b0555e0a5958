"""Phrase lists for the safety rules, all ours, written as patterns: ``{a|b} c {d|}`` stands for every choice."""

from __future__ import annotations

import re
from functools import cache
from itertools import product

PERSON = "{you|your {family|kids|children|wife|husband|mother|father|brother|sister|son|daughter|parents|dog|cat}|you {both|all}|u}"
THEIRS = "your {house|home|car|flat|room|place|shop|office|bike|windows|door}"
PATTERNS = {
    # what only a writer who names himself or herself as the one who acts threatens with
    "threat by agent": [
        "{kill|murder|hurt|stab|shoot|strangle|beat|slap|punch|attack|torture|poison|slaughter|maim|cripple|execute} " + PERSON,
        "beat {you|u} {up|senseless|to death}", "{put|leave} you in {hospital|a coffin|the ground}", "{make|let} you {bleed|suffer|scream|beg}", "end {you|your life}",
        "{burn|torch|smash|trash|wreck|vandalise|vandalize|destroy|rob|break into|blow up|set fire to} " + THEIRS,
        "{burn|smash} {it|the {house|flat|place}} down with you inside",
        "{break|smash|cut off|crush|rip off|twist} your {legs|leg|arms|arm|face|neck|bones|head|skull|fingers|hands|teeth|throat|nose|knees|jaw}",
        "{cut|slit} your {throat|wrists}", "{throw|pour} acid {on|at} {you|your face}", "{send|bring} {people|men|my friends|my boys} to {your {house|home|door|place}|hurt you|sort you out}", "teach you a lesson", "come after {you|your family}",
    ],
    "threat": [
        "you will regret {this|that|it|crossing me|the day}", "watch your back", "i know where {you|your {kids|family|parents}} {live|work|sleep|park|go to school}", "sleep with one eye open", "you {are|re} {dead|finished|a dead {man|woman}} {when|if|once|soon}",
        "{say|kiss} goodbye to your {family|life|kids|house}", "your days are numbered", "count your days", "you {wont|will not} {live|survive|make it} {to see|until|out|much longer}", "you {should|better|need to|must|can} {kill|hang|shoot|drown|stab} yourself",
        "{go|please|just} {kill|hang|shoot|drown} yourself", "{pay|paid} {for this|for that} {in|with} blood", "you {are|re} going to {die|bleed|get hurt}", "i {hope|pray} {you|u} {die|burn|get raped|get killed}", "nobody will find your body",
    ],
    "visit": ["{come|drive|ride|come back|come over} to your {house|home|place|flat|door|work|office|school}", "{find|visit|follow|hunt|track|stalk} you", "{show|turn} up at your {house|home|place|flat|door|work|office|school}", "{wait|be waiting|stand} outside your {house|home|place|flat|door|work|office|school}"],
    "selfHarm": [
        "{kill|hurt|cut|hang|shoot|drown|starve|harm} myself", "{want|wanna|wish|going|plan|planning|ready|would like} to {die|be dead|end my life|end it all|disappear forever|kill myself|not wake up}", "end my {own|} life", "take my own life", "{commit|thinking of|thinking about|considering} suicide",
        "i {am|m|feel} suicidal", "{no|any} reason to {live|go on living}", "{cant|cannot|dont want to} {go on|live} {anymore|any longer|any more}", "tired of {living|being alive}", "better off {dead|without me}", "wish i {was|were} dead", "{do not|dont} want to {live|be alive|exist}",
    ],
    "sexual": [
        "{send|show|give} {me|us|} {your|some|a|} {nudes|nude {photo|photos|pic|pics|video|videos}|naked {photo|photos|pic|pics|picture|pictures|video|videos|selfie}|dirty {photo|photos|pics}}", "{nude|naked} {photo|photos|pic|pics|picture|pictures|video|videos|selfie|selfies} of {you|yourself}",
        "{sleep|have sex|make love|hook up} with me", "{suck|ride|touch|lick} my {dick|cock|body}", "{show|touch|see|lick|grab} {me |}your {tits|boobs|ass|pussy|breasts|naked body}", "{come|get|join me} {to|into|in} my bed", "{want|love|like|going} to {fuck|undress|touch|sleep with|have sex with} you",
        "{sex|nude|naked} {chat|video call|video|cam|massage}", "{sex|favours|favors} for {money|cash|rent|a discount}", "{blow|hand} job", "happy ending massage", "what are you wearing {in bed|tonight|under}", "{are you|you} {horny|wet|naked} {now|tonight|right now|}",
    ],
    # these need a word for a person anywhere in the text
    "harassment by target": [
        "{you are|you re|youre|you were|ur|u r|you} {so |such a |a |an |really |just a |nothing but a |}{worthless|pathetic|disgusting|useless|subhuman|hideous|repulsive|vile|filthy|brainless|revolting|ugly|fat pig|piece of {shit|trash|garbage|filth}|waste of {space|air|oxygen}|disgrace|embarrassment|nobody|failure|joke|parasite}",
        "nobody {likes|loves|wants|needs|cares about|respects} you", "{no one|everyone|everybody} {likes|loves|hates|despises} you", "shut {up|your {mouth|face|trap|hole}} {you|idiot|stupid|now|bitch}", "you {disgust|sicken|repulse} {me|us}", "{go to|rot in|burn in} hell", "drop dead",
        "{fuck|screw|damn|curse} {you|u|off|yourself}", "{piss|bugger} off", "kiss my ass", "go {back to your country|back where you came from}", "i {hate|despise|loathe} you", "you {dont|do not} deserve {to live|to exist|love|a home}", "crawl back {to|into} {your|the} {hole|gutter|sewer}",
    ],
    "scam": [
        "{verify|confirm|update|validate|unlock|restore|reactivate} {your|the} {account|card|card details|identity|bank details|bank account|payment details|kyc|password|wallet}", "your {account|card|wallet|profile|booking} {will be|has been|is|was} {suspended|blocked|locked|limited|restricted|deactivated}",
        "{send|share|tell|give|forward|read|text|provide} {me|us|} {the|your|that|} {otp|otp code|one time password|one time code|verification code|sms code|login code|bank code|cvv|card pin|upi pin|card number|bank password|account password|email password|pin of your card}",
        "you {have|ve|} {won|been selected|been chosen} {a|the|for|as|an} {prize|lottery|reward|winner|gift|iphone|voucher|lucky}", "you have won", "{claim|collect|redeem} your {prize|reward|lottery|gift|winnings|cashback|voucher}", "{advance|processing|clearance|release|customs} fee", "{pay|paid|payment} {with|in|by|via} gift {cards|card}",
        "{buy|purchase|get} {me |some |}{itunes|steam|google play|amazon|apple} {gift |}{card|cards}", "{double|triple} your {money|bitcoin|investment|deposit}", "{guaranteed|risk free} {returns|profit|profits|income}", "{western union|moneygram} {transfer|me|the|to}", "{install|download} {anydesk|teamviewer} {so|and|to|for}",
    ],
    "demand": ["you {had|d|} better {pay|do|give|send|delete|leave|change|remove|refund}", "you will do {as|what} i {say|tell you|want}", "last {chance|warning} {to|before|or}", "{do it|pay|pay up|delete it|remove it|send it|give it|answer me} {now|today|immediately|} or", "{pay|give|send|refund|transfer} {me|us} {or|otherwise}", "this is your {last|final} {chance|warning}"],
    "illegitimate": [
        "{leak|post|publish|share|upload|spread|release|sell} {all |}{your|the|those|these} {photos|pictures|pics|videos|messages|chats|things|data|private data|address|number|nudes|secrets|documents|passport}", "{tell|show|send it to|inform|message} {all |}your {family|wife|husband|boss|parents|employer|friends|colleagues|neighbours|school}",
        "{ruin|destroy|wreck|end} {you|your {life|business|reputation|career|listing|name|marriage|family}}", "expose {you|your secret|your secrets|everything}", "make {you pay|you suffer|your life {hell|miserable}}", "your address to", "{everyone|the whole world|the whole town} will {see|know|hear} {it|your|what|about}", "{fake|false|fifty|hundred|hundreds of} {bad |}reviews",
        "spread {rumours|rumors|lies} about", "your {photos|pictures|videos|secrets|messages} {go|will go|end up|will be} {online|viral|public|everywhere}", "{hurt|beat|kill|harm|break} {you|your {kids|family|legs|windows}}", "report you for {rape|theft|drugs} {anyway|falsely}", "{get|have} you {deported|fired|evicted}",
    ],
    "lawful": [
        "{bad|negative|honest|poor|terrible|one star|1 star} {review|rating|feedback}", "{call|tell|inform|go to|contact|involve|report it to|report you to|report this to} the {police|authorities|council|consumer forum|tax office|cops}", "{file|lodge|make|raise|open|submit} a {complaint|report|dispute|claim|ticket|case}", "{consumer|small claims|civil} court", "{go|take you|take this|take it} to court",
        "{contact|report you to|report it to|report this to|report to|complain to|escalate to|call|tell} {support|customer service|customer care|the platform|the app|the company|the bank}", "{ask for|request|claim|want|demand|get} {a|my|the} {full |}refund", "{chargeback|charge back}", "legal {action|notice|steps}", "my {lawyer|solicitor|attorney}", "cancel {the|my|our} {booking|reservation|stay|order}",
    ],
}
GROUPS = "muslims hindus christians jews sikhs buddhists dalits blacks gays lesbians foreigners immigrants refugees bachelors women disabled africans asians arabs".split()
#: Dehumanising phrases, by rule; deployments add words of their own (sources.messages.read_lexicon).
PATTERNS["slur"] = ["{" + "|".join(GROUPS) + "} are {all |just |}{vermin|animals|cockroaches|parasites|filth|subhuman|rats|pests|scum}", "subhuman scum", "filthy vermin people", "gutter race", "{dirty|filthy} {" + "|".join(GROUPS) + "}"]
# Everyday obscenities and insults that count where they are said to a person.
STRONG = "bastard scumbag asshole arsehole motherfucker fucker bitch cunt prick dickhead twat wanker dipshit shithead slut whore jackass douchebag cocksucker bellend tosser scum fuckface dumbass bullshitter pervert degenerate lowlife sleazebag".split()
MILD = "idiot stupid moron trash liar fool dumb clown loser pig coward cheat crook thief imbecile jerk lunatic creep pathetic lazy incompetent fraud bewakoof gadha nikamma".split()
INDIC = "kamina kamine kameena kutta kutte kuttiya haramkhor harami haramzada nalayak badtameez suar badmash ghatiya".split()
# Phrases of other scripts; they are folded as texts are.
NATIVE_PATTERNS = {
    "threat": [
        "{мы |}тебя {убью|убьём|зарежу|изобью|сожгу|закопаю|придушу}", "{ты|вы} {пожалеешь|пожалеете|ответишь за это|ответите за это|умрёшь}", "я {знаю где ты живёшь|найду тебя|тебя найду|тебя достану}", "{сломаю|переломаю} тебе {ноги|руки|шею}",
        "{तुझे|तुम्हें|आपको} {मार|काट|जला|पीट} {दूंगा|दूंगी|देंगे|डालूंगा|डालेंगे}", "जान से मार {दूंगा|देंगे|डालूंगा}", "{हाथ|पैर|टांग} तोड़ {दूंगा|दूंगी|देंगे}", "{घर|गाड़ी} जला {दूंगा|देंगे}", "अंजाम {बुरा होगा|भुगतना पड़ेगा}",
    ],
    "selfHarm": ["хочу {умереть|покончить с собой|убить себя}", "{не хочу|больше не могу|устал|устала} жить", "मैं {मरना|खुद को खत्म करना} {चाहता|चाहती} {हूं|हूँ}", "{जीना|जिंदगी} नहीं {चाहता|चाहती|चाहिए}", "{आत्महत्या|खुदकुशी} {करना|कर लूंगा|कर लूंगी}"],
    "harassment": ["{ты|вы} {идиот|идиотка|ничтожество|дурак|дура|тупой|тупая|урод|мразь|сволочь|тварь}", "заткнись", "пошёл {вон|к чёрту}", "{तुम|तू|आप} {बेवकूफ|गधे|पागल|निकम्मे|घटिया|नीच} {हो|है|हैं}", "{चुप रह|मुंह बंद रख}"],
    "sexual": ["{пришли|скинь|покажи} {голые|интимные} фото", "{переспи|займись сексом} со мной", "{अपनी|मुझे} नंगी {फोटो|तस्वीर|वीडियो}", "मेरे साथ {सो जाओ|सोओगी}"],
    "scam": ["{сообщи|назови|пришли|скажи} {мне |}код {из смс|из сообщения}", "{подтвердите|обновите} {данные карты|ваш аккаунт}", "вы выиграли", "ओटीपी {भेजो|बताओ|बताइए|भेजिए}", "{आपने|आप} {इनाम|लॉटरी} {जीता|जीती} {है|हैं}"],
    "demand": ["वरना", "नहीं तो", "иначе"],
}


def choices(pattern: str) -> list[str]:
    """Every text that a pattern stands for."""
    out, depth, start, parts = [], 0, 0, []
    for i, c in enumerate(pattern):
        if c == "{":
            if depth == 0:
                parts.append([pattern[start:i]])
                start, options = i + 1, []
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                options.append(pattern[start:i])
                parts.append([x for o in options for x in choices(o)])
                start = i + 1
        elif c == "|" and depth == 1:
            options.append(pattern[start:i])
            start = i + 1
    parts.append([pattern[start:]])
    for chosen in product(*parts):
        out.append("".join(chosen))
    return out


@cache
def phrases(kind: str) -> tuple[str, ...]:
    return tuple(sorted({re.sub(" +", " ", x).strip() for p in PATTERNS[kind] for x in choices(p)}))


@cache
def native(kind: str) -> tuple[str, ...]:
    return tuple(sorted({re.sub(" +", " ", x).strip() for p in NATIVE_PATTERNS.get(kind, []) for x in choices(p)}))
