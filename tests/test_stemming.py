"""Stems against word pairs that are published with the rules."""

import pytest

from fundloom.functions import stemming

PAIRS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist
consistent consist consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori
console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol
consolingly consol consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu
conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir
constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack
knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel
knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit
knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker
knocking knock knocks knock knopp knopp knot knot knots knot fees fee fee fee returns return returned return yielding yield annualised annualis
generate generat generates generat generic generic communities communiti communism communism arsenic arsenic skies sky dying die news news
proceed proceed inning inning exceeded exceed hoping hope hopping hop hissing hiss flying fli cry cri by by say say enjoy enjoy
happily happili relational relat conditional condit rationalize ration vietnamization vietnam predication predic operator oper feudalism feudal
decisiveness decis hopefulness hope callousness callous formality formal sensitivity sensit sensibility sensibl triplicate triplic
formative format formalize formal electricity electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer
airliner airlin adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt
probate probat rate rate cease ceas controll control roll roll ties tie cried cri gas gas this this gaps gap kiwis kiwi agreed agre feed feed
luxuriated luxuri hopped hop fizzed fizz failing fail filing file""".split()


@pytest.mark.parametrize(("word", "want"), list(zip(PAIRS[::2], PAIRS[1::2], strict=True)))
def test_published_pairs(word, want):
    assert stemming.stem(word) == want


def test_memory_forgets():
    stems = stemming.Stems(most=2)
    assert [stems[w] for w in ("fees", "the", "yields", "fees")] == ["fee", None, "yield", "fee"]
    assert len(stems) <= 2
