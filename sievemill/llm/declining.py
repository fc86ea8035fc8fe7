"""Whether a sentence declines a task: a word n-gram naive Bayes model, trained on the sentences below at first use."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

#: Our own sentences that decline.
DECLINING = """
I won't do this one. I am not going to write that for you. That is not a thing I will produce. I would prefer to stay away from such topics.
Please ask somebody qualified about it. You had better turn to a specialist. I have to say no here. My answer is no, sorry about that.
We are not able to share advice on such matters. I can't take part in this. I cannot be of assistance here. I can not do that for you. I will not assist anybody with breaking into computers.
I must turn this down. I'm declining to respond. I refuse to continue. I decline to comment. I'm afraid this is beyond what I am permitted to say. Sorry, no can do. I'm sorry, this isn't allowed.
I apologise, but I have to pass on this. Apologies, I can't do it. My apologies, such material is off limits. Regretfully this is more than I am able to do. Unfortunately I'm not allowed to talk about it.
This goes against the rules I follow. That would violate my guidelines. My principles forbid it. Our policy prohibits such replies. The safety policy does not let me answer. The rules don't permit a reply.
As an assistant I don't engage with harmful content. As an AI I do not give instructions for attacks. Language models like me can't judge that. I was designed to avoid unsafe subjects.
It would be irresponsible for me to explain this. It would be unethical to help with this. It is inappropriate that I discuss it. For safety reasons I prefer not to reply. For legal reasons I keep silent. On ethical grounds I abstain.
Your request has been declined. The request was rejected. This message has been blocked by a filter. The reply was withheld by the moderation system. Access to this answer is denied by policy. The content was refused as unsafe.
Can we change the subject? Shall we speak of other things? Let us move on to another topic. I'd like to discuss something different. Let's drop this subject. Let us leave it there; ask another person. I would rather not go into that. I would rather not say.
I do not feel comfortable answering. I don't want to help with it. I don't supply that kind of content. I don't offer advice on hacking. I do not provide any such details. No, I do not hand out such information. Requests like yours are things I cannot support.
I am not permitted to hand out such help. Helping with attacks is nothing I may do. Talking about exploits is a subject I cannot cover. Giving such guidance is outside my remit. It lies outside what I am able to cover. It falls beyond the limits of what I may say.
Because this might cause harm, I will stop here. Since it could be misused, I cannot say more. As it may help criminals, I won't describe it. It might be dangerous, so I stay silent. I need to decline. We have to refuse. I must refuse politely.
We are unable to help you here. We are unable to help in breaking things. I cannot assist you in labelling threats, for this could help thieves. I can't assist in it. We are unable to assist. The prompt was stopped by a content policy. A content filter has blocked the output. No reply was made, as the prompt was blocked. I cannot map that for you. We can't classify harmful text.
Dabei kann ich leider nicht helfen. Das darf ich nicht beantworten. Es tut mir leid, dazu sage ich nichts. Ich möchte das lieber nicht tun. Je ne peux pas vous aider. Désolé, je refuse de répondre. Je préfère ne pas en parler. Lo siento, no puedo hacerlo. No puedo ayudar con eso. Prefiero no contestar.
Mi dispiace, non posso aiutare. Non posso rispondere a questo. Desculpe, não posso ajudar com isso. Het spijt me, daar kan ik niet bij helpen. Извините, я не могу с этим помочь. Я не буду отвечать на это. 抱歉，我无法提供帮助。我不能回答这个问题。
"""
#: Our own sentences of answers that do the task, or say that nothing fits.
ANSWERING = """
Nothing in the catalogue fits. None of the techniques applies here. There is no matching entry for it. No entry could be assigned. I found no technique that would match the text. No suitable mapping exists for such an event. Nothing applies.
The evidence is not strong enough to name one. The text does not say how the attack happened. The note is too vague for any label. The material does not support a choice. Too little is known to choose. I cannot tell from these words which technique was used.
I cannot see any behaviour in it that would match. I can not identify a technique with certainty. I am not sure which of the techniques is meant. I do not see a fit. We could not find a category for this entry. It is unclear whether any technique applies, so the list is empty.
The program accepts passwords that were shipped with it. The weakness lets a remote caller run code. A user without rights can read the files. The server does not check who is asking. The application cannot verify signatures and therefore loads altered files.
The machine refuses connections after the crash. The process is denied memory and stops. The device rejects valid requests when it is flooded. The filter can be bypassed with a long header. The service blocks users after three tries, which an attacker may abuse. The guard is unable to stop forged packets.
An intruder may enter by the open port. The attacker must be on the same network. Anyone can connect and change the settings. This allows other people to take over accounts. The best choice is access through a public service. The most likely technique is use of valid accounts.
It looks like a scan from outside. The behaviour suggests that data was moved out. It describes software which is no longer maintained. The summary speaks of exposure only. The description shows a missing check. The finding concerns a weak cipher. The record is about an old version.
The plugin does not escape its input. The user cannot change the setting. Customers cannot log in when the token has expired. The tool is not able to remove old keys. The manager does not permit long names. The vendor will not fix this version. The update was rejected because of a bad signature. The module is not allowed to write there.
Choosing this because the host answers anyone. I would assign the technique for exploitation of services. I picked the one that covers it best. I rate the confidence as low. Labels are given as a list. The result follows from the words about the protocol.
Here is the list. The answer is as follows. Techniques in order of confidence. These are the identifiers. See the entries above. No further entries. There was no sign of an attack. Analysts found no trace of misuse. Please patch the system soon. Please update the software soon. Sorry pages are shown to visitors.
"""
_TOKEN = re.compile(r"[^\W\d_]+|n['’]t\b")
_SENTENCE = re.compile(r"(?<=[.!?。！？;])\s*")
_HAN = re.compile(r"[぀-ヿ一-鿿]")
#: Log-odds above which a sentence declines.
LEAST_ODDS = 2.0


def features(sentence: str) -> list[str]:
    """Words, pairs of neighbours and, in Chinese or Japanese, pairs of characters; n't is a word."""
    text = re.sub(r"n['’]t\b", " not", re.sub(r"\bcan['’]t\b", "can not", re.sub(r"\bwon['’]t\b", "will not", sentence.lower())))
    text = re.sub(r"\bcannot\b", "can not", re.sub(r"['’](m|d|ll|s|re|ve)\b", r" \1", text))
    text = re.sub(r"\bi m\b", "i am", re.sub(r"\bi d\b", "i would", text))
    words = _TOKEN.findall(text)
    han = "".join(_HAN.findall(text))
    pairs = [f"{a} {b}" for a, b in zip(["^", *words], [*words, "$"], strict=True)]
    return ([] if han else words + pairs) + [han[i : i + 2] for i in range(len(han) - 1)]


@lru_cache(maxsize=1)
def weights() -> dict[str, float]:
    """Log-odds of each feature."""
    counted = [Counter(f for s in _SENTENCE.split(body) if s.strip() for f in set(features(s))) for body in (DECLINING, ANSWERING)]
    n = [sum(1 for s in _SENTENCE.split(body) if s.strip()) for body in (DECLINING, ANSWERING)]
    known = set(counted[0]) | set(counted[1])
    return {f: math.log((counted[0][f] + 0.5) / (n[0] + 1)) - math.log((counted[1][f] + 0.5) / (n[1] + 1)) for f in known}


def odds(text: str) -> float:
    """The greatest log-odds of a sentence of the text; only features seen in training count."""
    table = weights()
    return max((sum(table.get(f, 0.0) for f in set(features(s))) for s in _SENTENCE.split(text) if s), default=0.0)
