"""Pages of layouts that the labeller's grammar doesn't draw: written by hand, article leaves marked with a leading bullet."""

import pytest

from papyra.llm import html_text

SENTENCES = [
    "The harbour was quiet when the first boats came back, and nobody on the quay expected the news they carried.",
    "For two weeks the crew had followed the current south, counting birds by day and stars by night.",
    "What they found there, the captain said later, was neither an island nor a reef but something in between.",
    "The ministry has asked for the log books; a report is due before the end of the month.",
    "Scientists at the institute doubt the story, although the samples brought back are hard to explain.",
    "In the village, meanwhile, people talk of little else, and the inn has been full since Friday.",
]
P = [f"•{s}" for s in SENTENCES]

PAGES = {
    "tables": f"<table width=100%><tr><td bgcolor=#eee><a href=/>Home</a> | <a href=/n>News</a> | <a href=/s>Sport</a></td></tr><tr><td><table><tr><td width=20%><a href=1>Older story</a><br><a href=2>Another story</a></td><td><h1>•The boats come back</h1><p>{P[0]}<p>{P[1]}<p>{P[2]}</td></tr></table></td></tr><tr><td align=center>Copyright 2004 Harbour Weekly. All rights reserved.</td></tr></table>",
    "divs": f"<div id=wrap><div class=topbar><ul><li><a href=/>Start</a></li><li><a href=/about>About</a></li><li><a href=/login>Sign in</a></li></ul></div><div class=main-col><h2>•The boats come back</h2><div class=txt>{P[0]}</div><div class=txt>{P[1]}</div><div class=txt>{P[3]}</div></div><div class=right><h4>Most read</h4><a href=/a>Ten ways to cook fish</a><a href=/b>Weather for the weekend</a></div><div class=bottom>Contact | Imprint | Privacy</div></div>",
    "blog": f"<body><header><h1><a href=/>A blog on boats</a></h1><nav><a href=/archive>Archive</a> <a href=/tags>Tags</a></nav></header><main><article class=post><h2>•The boats come back</h2><p>{P[0]}</p><blockquote><p>{P[2]}</p></blockquote><ul><li>•Birds were counted every day of the journey.</li><li>•Stars were counted every night but two.</li></ul><p>{P[4]}</p></article><section id=comments><h3>3 comments</h3><div class=comment><p>Great post, thanks for sharing!</p></div><div class=comment><p>I was there and it was nothing like that.</p></div><form><label>Your name</label><input><button>Send</button></form></section></main><footer>Powered by pressware</footer></body>",
    "news": f"<div class=cookie-banner><p>We use cookies to improve your experience on our site. By going on you accept this.</p><button>Accept</button></div><header class=site-header><a href=/>The Daily Quay</a></header><div class=article-body><h1>•The boats come back</h1><p>{P[0]}</p><p>{P[1]}</p><div class=advert>Advertisement: cheap flights to the south from 49 euros</div><p>{P[3]}</p><figure><img src=x><figcaption>•The harbour on Monday, an hour before the boats came in.</figcaption></figure><p>{P[5]}</p></div><aside class=related><h3>Related stories</h3><ul><li><a href=1>Storm closes the port</a></li><li><a href=2>New ferry from spring</a></li></ul></aside><div class=newsletter><h3>Newsletter</h3><p>Sign up and never miss a story.</p><form><input><button>Subscribe</button></form></div><footer><p>© 2024 The Daily Quay. All rights reserved.</p></footer>",
    "docs": f"<nav class=sidebar-menu><ul><li><a href=#>Install</a></li><li><a href=#>Usage</a></li><li><a href=#>Reference</a></li></ul></nav><div class=content><h1>•How to read the log</h1><p>{P[3]}</p><h2>•Dates</h2><p>{P[1]}</p><pre>•log --from monday --to friday</pre><p>{P[4]}</p></div><footer><a href=#>Edit this page</a></footer>",
    "plain": f"<h1>•The boats come back</h1><p>{P[0]}</p><p>{P[1]}</p><p>{P[2]}</p><p>{P[5]}</p>",
    "spans": f"<div><span><a href=/>Top</a></span><span><a href=/x>Next</a></span></div><div><p><span>{P[0]}</span></p><p><em>{P[2]}</em></p><p>{P[4]}</p></div><div><small>Terms of use | Privacy policy</small></div>",
    "nested": f"<div><div><div><div><ul class=menu><li><a href=1>One</a><li><a href=2>Two</a></ul></div></div></div></div><div><div><section><div><h3>•The boats come back</h3><div><p>{P[1]}</p><p>{P[5]}</p></div></div></section></div></div><div class=social-share><a href=#>Share</a><a href=#>Tweet</a></div><div class=sidebar><p>About the author: she writes on the sea.</p></div>",
}


@pytest.fixture(scope="module")
def net():
    return html_text.train()


def judged(net):
    """Leaves that are called what they are, characters of articles that are found, characters found that are of articles."""
    right, total, kept, wanted, found = 0, 0, 0, 0, 0
    for page in PAGES.values():
        leaves = html_text.leaves(page)
        truth = [f.text.startswith("•") for f in leaves]
        plain = [html_text.Leaf(f.text.replace("•", ""), f.element, f.linked) for f in leaves]
        (prob,) = html_text.label(net, [plain])
        for leaf, t, p in zip(plain, truth, prob >= 0.5, strict=True):
            right, total = right + (t == p), total + 1
            wanted, found, kept = wanted + t * len(leaf.text), found + p * len(leaf.text), kept + (t and p) * len(leaf.text)
    return right / total, kept / wanted, kept / max(1, found)


def test_other_layouts(net):
    leaves, recall, precision = judged(net)
    print(f"leaves {leaves:.3f}, recall of characters {recall:.3f}, precision {precision:.3f}")
    assert leaves > 0.75 and recall > 0.8 and precision > 0.8
