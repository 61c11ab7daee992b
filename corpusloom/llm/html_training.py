"""Trains the block labeller of html.py on generated pages: python -m corpusloom.llm.html_training [pages] [epochs].

The generator varies layout, element names, class names, languages, order, depth and faults of the markup. Side matter
(adverts, notices, footers, comments) often holds prose like the article's, so that the path and the page's context have
to tell them apart; article text stands in many kinds of containers, with and without telling names.
"""

from __future__ import annotations

import random
import sys

import numpy as np

from .html import MEASURES, MODEL, PATH_BUCKETS, WORD_BUCKETS, Block, Element, Labeller, bag_means, lstm_states, measures, path_buckets, read_blocks, word_buckets

SYLLABLES = ["an er in on re th the ti es en at ed nd ha to or is it ing ou", "en er ch de ein ge ung sch lich heit te zu be ver auf", "de la que en ción el os as ado ar mente ue ie co do", "le de la les ré é tion eau que ment an ou ai eux pa"]
MENU = "Home About Contact Login Search Products Services News Blog Archive Help Support Careers Sitemap Accueil Startseite Inicio Impressum Kontakt".split()
TALK = ["Reply", "Report", "Like", "posted by", "says:", "Share", "Permalink", "Antworten", "Responder", "Répondre"]
BUTTONS = ["Subscribe", "Sign up", "Submit", "Send", "OK", "Accept", "Close", "Email address", "Your name", "Anmelden", "Enviar", "Envoyer", "Search"]

#: Plain words and set phrases, so that not all text is made of syllables.
PLAIN = [
    "the of and to in that it was for on with as his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know",
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei",
    "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué solo han yo hay vez puede todos así nos ni parte tiene",
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la mais avec ou comme été son tout nous sa cette ont aux être fait leur même deux ces dont elle si ans encore aussi peut où bien sans je mon vous",
]
SAID = {
    "advert": "Buy now and save;Limited offer;Shop the sale;Sponsored content;Free shipping on all orders;Learn more about our plans;Jetzt kaufen;Publicidad;Annonce".split(";"),
    "notice": "We use cookies to improve your experience;By continuing you accept our privacy policy;Please enable JavaScript;Accept all cookies;This site uses cookies;Wir verwenden Cookies;Usamos cookies;Nous utilisons des cookies".split(";"),
    "talk": "Great post, thanks;I disagree with this;First comment;Thanks for sharing;Could you explain this;Danke;Gracias;Merci".split(";"),
    "foot": "All rights reserved;Terms of use;Privacy policy;Powered by;Impressum;Aviso legal;Mentions légales".split(";"),
}
#: Kind of region: (element names, marks that its class or id may carry, may it come without a mark).
SIDE = {
    "menu": ("nav ul div nav nav", "nav menu navbar navigation main-menu topnav breadcrumb breadcrumbs links tabs pagination toc", True),
    "head": ("header div header", "header masthead site-header banner top branding logo page-header hero", True),
    "foot": ("footer div footer", "footer site-footer bottom copyright colophon legal footnotes credits", True),
    "side": ("aside div section aside", "sidebar side widget related more-stories aside rail recommended trending popular tags", True),
    "advert": ("div section aside ins div", "ad ads advert advertisement sponsored promo ad-slot banner-ad adsbygoogle promoted sponsor", False),
    "notice": ("div section p aside dialog", "notice cookie cookie-banner alert consent gdpr message warning disclaimer popup modal overlay announcement", False),
    "form": ("form form div", "form newsletter signup login subscribe search contact-form register", False),
    "talk": ("section div ol ul section", "comments comment-list discussion responses replies comment-thread disqus user-comments", False),
    "share": ("div ul p", "share social sharing follow meta byline toolbar actions", False),
}
#: Attributes that tell nothing.
DRESS = (' style="color:red"', ' style="margin:0; padding:2px"', ' data-x="1"', ' lang="en"')
HIDDEN = (' style="display:none"', ' style="display: none;"', " hidden", ' style="visibility:hidden"', ' aria-hidden="true"')
MAIN = ("article main div section td div article", "article content post entry story main post-body article-body entry-content text body-text page-content blog-post post-content", True)


class Maker:
    """One random page, with the texts of its main blocks in order."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.main: list[str] = []
        language = self.r.randrange(len(SYLLABLES))
        self.syllables, self.plain = SYLLABLES[language].split(), PLAIN[language].split()
        self.share = self.r.choice((0, 0, 0.3, 0.6))
        #: How the page is laid out: with named regions, in nameless divs, in a table, or as bare text.
        self.layout = self.r.choices(("named", "bare", "table", "text"), (76, 12, 8, 4))[0]
        self.unclosed = self.r.random() < 0.3

    def word(self) -> str:
        if self.share and self.r.random() < self.share:
            return self.r.choice(self.plain)
        w = "".join(self.r.choices(self.syllables, k=self.r.choice((1, 1, 2, 2, 3, 4))))
        return w + self.r.choice(("", "", "", "", "***", "%%%", "###", "&amp;&amp;&amp;")) if self.r.random() < 0.04 else w

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self) -> str:
        if self.r.random() < 0.02:
            return " ".join([self.word()] * self.r.randint(2, 12)) + self.r.choice((".", ""))
        return self.words(1, 18).capitalize() + self.r.choice((".", ".", ".", "!", "?"))

    def prose(self, most: int = 8) -> str:
        return " ".join(self.sentence() for _ in range(self.r.choice((1, 1, 2, self.r.randint(1, most)))))

    def ref(self, text: str) -> str:
        return f'<a href="/{self.r.randint(0, 999)}">{text}</a>'

    def opened(self, kind: tuple) -> tuple[str, str]:
        names, marks, bare = kind
        if self.layout != "named":
            return "div", "<div>"
        name = self.r.choice(names.split())
        if bare and self.r.random() < 0.4 and name not in ("div", "td", "ul", "ol", "p", "section"):
            return name, f"<{name}>"
        mark = self.r.choice(marks.split())
        style = self.r.random()
        if style < 0.15:
            mark = f"{mark} {self.word()}"
        elif style < 0.25:
            mark = f"{self.r.choice(('js', 'c', 'l', 'site', 'page', 'block'))}-{mark}"
        elif style < 0.3:
            mark = mark.title().replace("-", "")
        attribute = "id" if self.r.random() < 0.25 else "class"
        return name, f'<{name} {attribute}="{mark}"{self.r.choice(DRESS) if self.r.random() < 0.1 else ""}>'

    def links(self, n: int) -> str:
        text = lambda: self.r.choice(MENU) if self.r.random() < 0.4 else self.words(1, 5)
        if self.r.random() < 0.75:
            return "<ul>" + "".join(f"<li>{self.ref(text())}</li>" for _ in range(n)) + "</ul>"
        return self.r.choice((" | ", " ", " &middot; ")).join(self.ref(text()) for _ in range(n))

    def side(self, kind: str, depth: int = 0) -> str:
        r = self.r
        name, start = self.opened(SIDE[kind])
        if kind == "menu":
            inner = self.links(r.randint(2, 9))
        elif kind == "head":
            inner = "".join(r.sample([f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.words(2, 8)}</p>", f"<div>{self.ref(self.words(1, 3))}</div>", self.links(3), f"<span>{self.words(1, 4)}</span>"], r.randint(1, 3)))
        elif kind == "foot":
            first = r.choice(("&copy; ", "© ", "Copyright ", "", "(c) "))
            inner = r.choice((f"{first}{self.words(1, 3)} &middot; {self.prose(2)}", f"<p>{first}{r.randint(1990, 2030)} {self.words(1, 4)}</p>{self.links(3)}", f"<div>{self.prose(3)}</div><p>{first}{self.word()}</p>", self.links(4), f"{self.prose(2)}"))
        elif kind == "side":
            inner = "".join(r.choice((f"<h3>{self.words(1, 4)}</h3>", self.links(r.randint(2, 6)), f"<p>{self.prose(3)}</p>", f"<div>{self.prose(2)}</div>")) for _ in range(r.randint(1, 4)))
        elif kind in ("advert", "notice"):
            inner = r.choice((self.prose(3), f"<p>{self.prose(3)}</p>", f"<p>{self.sentence()}</p><button>{r.choice(BUTTONS)}</button>", self.ref(self.sentence()), f"<div>{self.prose(2)}</div>", f"<strong>{self.words(1, 3)}</strong> {self.sentence()}"))
        elif kind == "form":
            inner = "".join(r.choice((f"<label>{self.words(1, 3)}</label><input>", f"<p>{self.prose(2)}</p>", f"<button>{r.choice(BUTTONS)}</button>", f"<select><option>{self.word()}</option><option>{self.word()}</option></select>", f"<textarea>{self.words(0, 3)}</textarea>")) for _ in range(r.randint(1, 5)))
        elif kind == "talk":
            item = r.choice(("li", "div", "article", "div", "p"))
            mark = f' class="{r.choice(("comment", "reply", "response", "comment-body", "post-comment"))}"' if r.random() < 0.6 else ""
            inner = (f"<h3>{r.randint(1, 99)} {r.choice(('Comments', 'Kommentare', 'Comentarios', 'Commentaires', 'Replies'))}</h3>" if r.random() < 0.6 else "") + "".join(
                f"<{item}{mark}>" + (f"<b>{self.words(1, 2)}</b> {r.choice(TALK)} " if r.random() < 0.5 else "") + (self.prose(3) if item == "p" or r.random() < 0.5 else f"<p>{self.prose(3)}</p>") + f"</{item}>" for _ in range(r.randint(1, 6))
            )
        else:
            inner = r.choice((self.links(3), f"{r.choice(('By', 'Von', 'Por', 'Par'))} {self.words(2, 2)}", " ".join(self.ref(x) for x in ("Facebook", "Twitter", "Email"))))
        if kind in SAID and r.random() < 0.3:
            inner = r.choice((f"{r.choice(SAID[kind])}. {inner}", f"<p>{r.choice(SAID[kind])}.</p>{inner}"))
        if kind in ("notice", "advert", "share") and r.random() < 0.1:
            start = start[:-1] + r.choice(HIDDEN) + ">"
        return f"{start}{inner}</{name}>"

    def keep(self, text: str) -> str:
        """Article text, which is noted."""
        self.main.append(text)
        return text

    def inline(self, text: str) -> str:
        words = text.split(" ")
        if len(words) > 4 and self.r.random() < 0.3:
            i = self.r.randrange(len(words) - 2)
            tag = self.r.choice(("b", "i", "em", "strong", "span", "code"))
            words[i] = f"<{tag}>{words[i]}"
            words[i + 1] += f"</{tag}>"
        elif len(words) > 4 and self.r.random() < 0.15:
            i = self.r.randrange(len(words))
            words[i] = self.ref(words[i])
        return " ".join(words)

    def paragraph(self) -> str:
        r, x = self.r, self.r.random()
        if self.layout == "text":
            return f"{self.inline(self.keep(self.prose(10)))}{r.choice(('<br>', '<br><br>'))}"
        if self.layout == "table" and x < 0.3:
            return f"<font size=2>{self.inline(self.keep(self.prose(10)))}</font><br><br>"
        if self.layout == "bare" and x < 0.25:
            return f"<div>{self.inline(self.keep(self.prose(10)))}</div>"
        if x < 0.05 and self.layout == "named":  # set phrases of side matter stand in articles too
            return f"<p>{self.keep(r.choice(r.choice(list(SAID.values()))) + r.choice(('.', '.', '!', '')))}</p>"
        if x < 0.68:
            return f"<p>{self.inline(self.keep(self.prose(14)))}" + ("" if self.unclosed and r.random() < 0.5 else "</p>")
        if x < 0.74:
            return f"<p><b>{self.keep(self.prose(3))}<br><p>{self.keep(self.prose(6))}</p>"
        if x < 0.82:
            h = r.choice(("h2", "h3", "h4"))
            return f"<{h}>{self.keep(self.words(1, 8))}</{h}>"
        if x < 0.88:
            tag = r.choice(("ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{self.inline(self.keep(self.prose(2)))}" + ("" if self.unclosed else "</li>") for _ in range(r.randint(1, 6))) + f"</{tag}>"
        if x < 0.92:
            return f"<blockquote>{self.keep(self.prose(4))}</blockquote>"
        if x < 0.95:
            return "<table>" + "".join(f"<tr><td>{self.keep(self.words(1, 3))}</td><td>{self.keep(self.words(1, 3))}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>"
        if x < 0.98:
            return f'<figure><img src="x.png"><figcaption>{self.keep(self.sentence())}</figcaption></figure>'
        return f"<pre>{self.keep(self.words(3, 12))}</pre>"

    def article(self) -> str:
        r = self.r
        name, start = self.opened(MAIN)
        if name == "td":
            name, start = "div", start.replace("<td", "<div")
        inner = f"<h1>{self.keep(self.words(2, 12))}</h1>" if r.random() < 0.85 else ""
        for _ in range(r.choice((1, 2, 3, r.randint(1, 24)))):
            inner += self.paragraph()
            if r.random() < 0.03:
                inner += self.side(r.choice(("advert", "share", "side", "form", "notice"))) if self.layout == "named" else ""
            if self.layout == "named" and r.random() < 0.02:  # hidden text inside
                inner += f"<div{r.choice(HIDDEN)}>{self.prose(2)}</div>"
        return f"{start}{inner}</{name}>"

    def nameless(self) -> str:
        """A page whose regions carry no names: links above or beside, the article, a last line."""
        r = self.r
        if self.layout == "text":
            return "".join(self.paragraph() for _ in range(r.choice((1, 2, r.randint(1, 12)))))
        last = f"{r.choice(('&copy; ', '© ', 'Copyright ', ''))}{r.randint(1990, 2030)} {self.words(1, 3)}. {r.choice(SAID['foot'])}"
        before = "".join(self.side(k) for k in ("head", "menu") if r.random() < 0.8)
        article = (f"<h{h}>{self.keep(self.words(2, 10))}</h{h}>" if (h := r.choice((0, 1, 1, 2))) else "") + "".join(self.paragraph() for _ in range(r.choice((1, 2, 4, r.randint(1, 16)))))
        after = self.side("menu") if r.random() < 0.2 else ""
        if self.layout == "bare":
            article = r.choice((article, f"<div>{article}</div>", f"<div><div>{article}</div></div>"))
            return f"{before}{article}{after}<div>{last}</div>" if r.random() < 0.7 else f"<div>{before}<div>{article}</div>{after}<p>{last}</p></div>"
        beside = "<br>".join(self.ref(r.choice(MENU) if r.random() < 0.5 else self.words(1, 3)) for _ in range(r.randint(2, 9)))
        width = r.choice(("", " width=150", " valign=top"))
        top = f"<tr><td colspan=2>{self.words(1, 4)}</td></tr>" if r.random() < 0.5 else ""
        return f"<table{r.choice(('', ' border=0', ' cellpadding=4'))}>{top}<tr><td{width}>{beside}</td><td>{article}</td></tr><tr><td colspan=2>{last}</td></tr></table>"

    def page(self) -> str:
        r = self.r
        if self.layout != "named":
            body = self.nameless()
            return r.choice((body, f"<html><body>{body}</body></html>", f"<html><head><title>{self.words(2, 8)}</title></head><body bgcolor=white>{body}"))
        before = [self.side(k) for k in ("head", "menu", "notice", "advert", "menu", "form", "share") if r.random() < (0.75 if k == "menu" else 0.3)]
        after = [self.side(k) for k in ("share", "advert", "side", "talk", "form", "menu", "notice") if r.random() < 0.3]
        if r.random() < 0.3:
            r.shuffle(before)
        if r.random() < 0.3:
            r.shuffle(after)
        body = "".join(before)
        if r.random() < 0.2:
            body += self.side("side")
        body += f"<!-- {self.words(1, 3)} -->" * (r.random() < 0.5)
        body += self.article() + "".join(after) + (self.side("foot") if r.random() < 0.9 else "")
        for _ in range(r.choice((0, 0, 0, 1, 1, 2))):
            body = r.choice((f"<div>{body}</div>", f'<div class="{r.choice(("wrapper", "container", "page", "row", "site", "layout"))}">{body}</div>', f'<div id="{r.choice(("root", "app", "wrap", "outer"))}">{body}</div>'))
        end = "" if r.random() < 0.15 else "</body></html>"
        return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>{body}{end}'


def labelled_page(seed: int) -> tuple[list[Block], np.ndarray, str]:
    """Blocks, labels and main text of a generated page. A block is main if it is the next noted text, tags aside."""
    import html as entities

    maker = Maker(seed)
    blocks = read_blocks(maker.page())
    wanted = [" ".join(entities.unescape(t).split()) for t in maker.main]
    labels, at = np.zeros(len(blocks), np.float32), 0
    for i, b in enumerate(blocks):
        if at < len(wanted) and b.text == wanted[at] and _inside(b.path):
            labels[i] = 1
            at += 1
    return blocks, labels, " ".join(wanted) if at == len(wanted) else "\0"


def _inside(path: Element | None) -> bool:
    """A text that side matter repeats by chance isn't taken for the article's."""
    while path is not None:
        if path.marks[0] in ("nav", "footer", "aside", "header", "form"):
            return False
        path = path.parent
    return True


def train(n_pages: int, epochs: int, path_size: int = 32, word_size: int = 12, hidden: int = 24) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(7)
    width = path_size + word_size + MEASURES
    p = {"path": rng.normal(0, 0.3, (PATH_BUCKETS, path_size)), "word": rng.normal(0, 0.2, (WORD_BUCKETS, word_size)), "out": rng.normal(0, 0.1, (2 * hidden + width, 1)), "out_bias": np.zeros(1)}
    for d in ("forward", "backward"):
        p |= {f"{d}_x": rng.normal(0, width**-0.5, (width, 4 * hidden)), f"{d}_h": rng.normal(0, hidden**-0.5, (hidden, 4 * hidden)), f"{d}_b": np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    pages = [x for s in range(n_pages) if (x := labelled_page(s))[0] and x[2] != "\0"]
    ready = [([path_buckets(b.path) or (0,) for b in bl], [word_buckets(b.text) for b in bl], np.array([measures(b, i, len(bl)) for i, b in enumerate(bl)], np.float32), y) for bl, y, _ in pages]
    for epoch in range(epochs):
        order, total, wrong, seen = rng.permutation(len(ready)), 0.0, 0, 0
        rate = 4e-3 * (1 - epoch / epochs) + 2e-4
        for at in range(0, len(order), 32):
            batch = [ready[i] for i in order[at : at + 32]]
            loss, errors, count, grads = gradients(p, batch, hidden, rng)
            total, wrong, seen, step = total + loss, wrong + errors, seen + count, step + 1
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        print(f"epoch {epoch}: loss {total / seen:.4f}, wrong {wrong} of {seen}", flush=True)
    return p


def gradients(p: dict, batch: list, hidden: int, rng) -> tuple[float, int, int, dict]:
    """Loss, errors, blocks and the loss's gradients of a batch, by backpropagation through time."""
    lengths = np.array([len(x[3]) for x in batch])
    paths, words = [b for x in batch for b in x[0]], [b for x in batch for b in x[1]]
    # some blocks lose their path or words, so that the context has to tell
    drop_path, drop_word = rng.random(len(paths)) < 0.03, rng.random(len(words)) < 0.5
    path_in = np.tanh(bag_means(p["path"], paths)) * ~drop_path[:, None]
    word_in = np.tanh(bag_means(p["word"], words)) * ~drop_word[:, None]
    flat = np.concatenate([path_in, word_in, np.concatenate([x[2] for x in batch])], 1).astype(np.float32)
    steps = lengths.max()
    x, y, mask = np.zeros((steps, len(batch), flat.shape[1]), np.float32), np.zeros((steps, len(batch)), np.float32), np.zeros((steps, len(batch)), np.float32)
    spot = [(np.arange(n), np.full(n, k)) for k, n in enumerate(lengths)]
    rows, columns = np.concatenate([a for a, _ in spot]), np.concatenate([b for _, b in spot])
    x[rows, columns], y[rows, columns], mask[rows, columns] = flat, np.concatenate([b[3] for b in batch]), 1
    tapes: dict[str, list] = {"forward": [], "backward": []}
    states = [lstm_states(x, lengths, p, d, tapes[d]) for d in tapes]
    joined = np.concatenate([*states, x], 2)
    odds = (joined @ p["out"] + p["out_bias"])[:, :, 0]
    chance = 0.5 * (np.tanh(0.5 * odds) + 1)
    loss = float((mask * (np.logaddexp(0, odds) - y * odds)).sum())
    errors = int((mask * ((odds > 0) != (y > 0.5))).sum())
    d_odds = ((chance - y) * mask / lengths.sum())[:, :, None]
    g = {"out": np.einsum("tnk,tno->ko", joined, d_odds), "out_bias": d_odds.sum((0, 1))}
    d_joined = d_odds @ p["out"].T
    d_x = d_joined[:, :, 2 * hidden :].copy()
    for at, d in enumerate(tapes):
        d_h, d_c = np.zeros((len(batch), hidden), np.float32), np.zeros((len(batch), hidden), np.float32)
        d_gates = np.zeros((steps, len(batch), 4 * hidden), np.float32)
        g_u = np.zeros_like(p[f"{d}_h"])
        for t, live, i, f, o, z, c, h, squashed in reversed(tapes[d]):
            d_out = (d_h + d_joined[t, :, at * hidden : (at + 1) * hidden]) * live
            d_cell = d_c * live + d_out * o * (1 - squashed**2)
            d_g = np.concatenate([d_cell * z * i * (1 - i), d_cell * c * f * (1 - f), d_out * squashed * o * (1 - o), d_cell * i * (1 - z**2)], 1)
            d_gates[t] = d_g
            g_u += h.T @ d_g
            d_h, d_c = d_g @ p[f"{d}_h"].T, d_cell * f
        g |= {f"{d}_h": g_u, f"{d}_x": np.einsum("tnk,tng->kg", x, d_gates), f"{d}_b": d_gates.sum((0, 1))}
        d_x += d_gates @ p[f"{d}_x"].T
    d_flat = d_x[rows, columns]
    size = path_in.shape[1]
    for name, bags, values, part, dropped in (("path", paths, path_in, d_flat[:, :size], drop_path), ("word", words, word_in, d_flat[:, size : size + word_in.shape[1]], drop_word)):
        sizes = np.array([len(b) for b in bags])
        d_sum = part * (1 - values**2) * ~dropped[:, None] / np.sqrt(sizes)[:, None]
        g[name] = np.zeros_like(p[name])
        np.add.at(g[name], np.fromiter((i for b in bags for i in b), np.int64, sizes.sum()), np.repeat(d_sum, sizes, 0))
    return loss, errors, len(rows), g


def held_out(p: dict, first: int, n: int) -> tuple[float, float]:
    """Shares of blocks and of whole pages that are labelled right, on pages from seed first on."""
    pages = [x for s in range(first, first + n) if (x := labelled_page(s))[0] and x[2] != "\0"]
    right = [(odds > 0) == (y > 0.5) for odds, (_, y, _) in zip(Labeller(p).scores([x[0] for x in pages]), pages, strict=True)]
    return float(np.concatenate(right).mean()), float(np.mean([r.all() for r in right]))


if __name__ == "__main__":
    trained = train(int(sys.argv[1]) if len(sys.argv) > 1 else 8000, int(sys.argv[2]) if len(sys.argv) > 2 else 8)
    print("held out: blocks %.5f, pages %.4f" % held_out(trained, 10_000_000, 1500))
    MODEL.parent.mkdir(exist_ok=True)
    np.savez_compressed(MODEL, **{k: v.astype(np.float16) for k, v in trained.items()})
