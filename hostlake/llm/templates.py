"""Invented pages whose article is known; a block labeller learns from them."""

from __future__ import annotations

from random import Random

#: Begins every block of the article (it is taken off before anything is learnt).
MARK = "\ue000"

#: Kinds of blocks that aren't the article: elements, names, and what they tend to say (in several languages). fixed values
OTHERS = {
    "menu": ("nav div ul", "nav menu navbar main-nav navigation topnav breadcrumb breadcrumbs site-menu nav-links pagination skip-link", "Home|About us|Contact|Products|Blog|News|Start|Über uns|Kontakt|Accueil|À propos|Inicio|Contacto|Skip to content|Next page|Previous|Sitemap"),
    "header": ("header div", "header site-header masthead top topbar branding logo tagline page-header banner", "Your daily source|Log in|Sign up|Search|The home of everything|Anmelden|Connexion|Iniciar sesión"),
    "footer": ("footer div", "footer site-footer bottom colophon copyright legal page-footer credits", "© 2024 All rights reserved|Privacy policy|Terms of use|Impressum|Datenschutz|Mentions légales|Aviso legal|Powered by|Contact us|Imprint|&copy; example.com &middot;"),
    "aside": ("aside div section", "sidebar side widget related rail recommended popular trending secondary tags related-posts teaser more-stories", "Related articles|Most read|You may also like|Popular posts|Tags|Archive|Mehr zum Thema|À lire aussi|Te puede interesar|Recommended"),
    "notice": ("div section p aside dialog", "cookie cookie-banner notice consent gdpr alert popup modal overlay disclaimer paywall message warning announcement", "We use cookies to improve your experience.|Accept all|Reject|Diese Website verwendet Cookies.|Nous utilisons des cookies.|Usamos cookies.|Please enable JavaScript|This site is best viewed|Manage preferences"),
    "advert": ("div aside section ins p", "ad ads advert advertisement sponsored promo banner-ad sponsor ad-slot adbox promotion commercial", "Advertisement|Sponsored|Anzeige|Publicité|Publicidad|Buy now|Best deals|50% off|Promoted content|Limited offer"),
    "form": ("form div", "search-form login subscribe contact newsletter signup form search register subscription", "Search|Email|Password|Subscribe to our newsletter|Send|Name|Your email address|Abonnieren|S'abonner|Suscribirse|Sign up"),
    "comments": ("section div ol ul", "comments comment-list comment responses replies discussion thread respond reader-comments user-comments commentlist", "3 comments|Reply|said:|Leave a comment|Antworten|Répondre|Responder|Kommentare|Commentaires|Report|Post a comment|says"),
    "share": ("div ul p", "share social sharing follow share-buttons social-links", "Share on Facebook|Tweet|Pin it|Teilen|Partager|Compartir|Follow us|Email this"),
}
#: Names that articles' containers tend to have. fixed values
CONTAINERS = "content main article post entry entry-content post-body article-body story story-text body text main-content page-content article-content blog-post news-text".split()
#: Names of no meaning.
PLAIN = "row col wrapper container inner outer box grid block item c1 x2 layout page site-inner wrap section clearfix".split()

SYLLABLES = "an be ca do er fi ga ho in ju ka lo ma ne or pa qui re st tion un ver wh ou ly the ing ed en ä é ü ñ sch ción eau ment keit über".split()


class Pages:
    """Pages of random structure from a seed."""

    def __init__(self, seed: int) -> None:
        self.r = Random(seed)

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4)))

    def sentence(self, low: int = 4, high: int = 22) -> str:
        words = [self.word() for _ in range(self.r.randint(low, high))]
        words = [w + ("," if self.r.random() < 0.08 else "") for w in words]
        words[0] = words[0].capitalize()
        return " ".join(words) + self.r.choice("....!?")

    def prose(self, high: int = 6) -> str:
        text = " ".join(self.sentence(1 if self.r.random() < 0.2 else 4) for _ in range(self.r.randint(1, high)))
        return self.odd(text) if self.r.random() < 0.12 else text

    def odd(self, text: str) -> str:
        """Short, odd and damaged text, as is found in articles and elsewhere."""
        words = text.split()
        return self.r.choice([
            self.word(), self.word().capitalize() + ".", self.sentence(1, 3), text.upper(), " | ".join(words) + self.r.choice(["", " |"]), " | ".join(words[:4]) + " |",
            " ".join(w + self.r.choice(["###", "%%%", "***", "$$$", "!!!"]) for w in words), " ".join(w for w in words[:6] for _ in range(self.r.randint(1, 20))),
            f"{self.word()}@example.com {self.r.randint(0, 10**9)}", f"https://{self.word()}.example.org/{self.r.randint(0, 999)}", "All rights reserved. " + text, "Released under the license. " + text,
        ])

    def inline(self, text: str) -> str:
        if self.r.random() < 0.25:
            words = text.split(" ")
            at = self.r.randrange(len(words))
            tag = self.r.choice(["b", "i", "em", "strong", "a", "span", "code"])
            words[at] = f'<a href="/x">{words[at]}</a>' if tag == "a" else f"<{tag}>{words[at]}</{tag}>" if self.r.random() < 0.85 else f"<{tag}>{words[at]}"
            text = " ".join(words)
        return text.replace(". ", ".<br>", 1) if self.r.random() < 0.08 else text

    def names(self, pool: list[str], chance: float = 0.8) -> str:
        if self.r.random() > chance:
            return ""
        name = self.r.choice(pool)
        if self.r.random() < 0.3:
            name = self.r.choice([f"{name}-{self.r.choice(PLAIN)}", f"{self.r.choice(PLAIN)} {name}", f"{name}__{self.r.choice(PLAIN)}", f"js-{name}"])
        return f' {self.r.choice(["class", "class", "id"])}="{name}"'

    def other(self, kind: str) -> str:
        """A part of ``kind`` that isn't the article."""
        r = self.r
        tags, names, says = OTHERS[kind]
        tag = r.choice(tags.split())
        telling = tag in ("nav", "header", "footer", "aside", "form")
        head = f"<{tag}{self.names(names.split(), 0.5 if telling else 1.0)}>"
        phrase = lambda: r.choice(says.split("|")) if r.random() < 0.5 else " ".join(self.word() for _ in range(r.randint(1, 4)))
        link = lambda: f'<a href="/{self.word()}">{phrase()}</a>'
        listed = lambda: "".join(f"<li>{link() if r.random() < 0.85 else phrase()}</li>" for _ in range(r.randint(2, 7)))
        if kind == "comments":
            one = lambda: f"<{(c := r.choice(['div', 'li', 'p', 'article']))}{self.names(['comment', 'comment-body', 'reply', 'response'], 0.7)}>{r.choice(['', f'<b>{self.word()}</b> ', f'<span>{phrase()}</span>'])}{'<p>' if c != 'p' and r.random() < 0.5 else ''}{self.prose(3)}</{c}>"
            body = (f"<h{r.randint(2, 4)}>{phrase()}</h3>" if r.random() < 0.6 else "") + "".join(one() for _ in range(r.randint(1, 6)))
        elif kind == "form":
            tag, head = ("form", f"<form{self.names(names.split(), 0.6)}>") if r.random() < 0.85 else (tag, head)
            body = "".join(r.choice([f"<label>{phrase()}</label><input name=q>", f"<button>{phrase()}</button>", f"<p>{phrase()}</p>", f"<select><option>{self.word()}<option>{self.word()}</select>", f"<textarea>{phrase()}</textarea>"]) for _ in range(r.randint(1, 4)))
        elif kind in ("menu", "share"):
            body = (f"<ul>{listed()}</ul>" if tag != "ul" else listed()) if r.random() < 0.75 else " | ".join(link() for _ in range(r.randint(2, 6)))
        elif kind == "advert":
            body = r.choice([self.prose(2), f"<p>{self.prose(2)}</p>", phrase(), f"<a href=/x>{self.sentence()}</a>"])
        elif kind == "notice":
            body = r.choice([f"<p>{phrase()} {self.sentence()}</p><button>{phrase()}</button>", self.prose(2), f"{phrase()} <a href=/x>{phrase()}</a>"])
        elif kind == "aside":
            body = (f"<h{r.randint(2, 4)}>{phrase()}</h2>" if r.random() < 0.6 else "") + r.choice([f"<ul>{listed()}</ul>", f"<p>{self.prose(2)}</p>", "".join(f"<div><a href=/x>{self.sentence()}</a></div>" for _ in range(3))])
        elif kind == "header":
            body = r.choice([f"<h1>{phrase()}</h1>", f"<div>{phrase()}</div>", f'<a href="/">{phrase()}</a>', f"<p>{phrase()}</p>"]) + (f"<ul>{listed()}</ul>" if r.random() < 0.3 else "")
        else:
            body = r.choice([f"<p>{phrase()} {self.sentence()}</p>", f"<ul>{listed()}</ul>", f"{phrase()} {self.sentence()}", phrase()])
        return f"{head}{body}</{tag}>"

    def article(self) -> str:
        """Blocks of an article, each marked, with now and then a foreign part between."""
        r = self.r
        out = [f"<h{r.choice([1, 1, 1, 2])}>{MARK}{self.sentence(2, 12).rstrip('.')}</h1>"] if r.random() < 0.85 else []
        if out and r.random() < 0.15:
            out = [f"<header>{out[0]}</header>"]
        for _ in range(r.choice([1, 2, 3, 5, 8, 12, 20])):
            x = r.random()
            p = f"<p{self.names(['lead', 'intro', 'para', 'text'], 0.1)}>"
            if x < 0.74:
                text = " ".join(self.sentence(1, 6) for _ in range(r.randint(1, 2))) if r.random() < 0.3 else self.odd(self.prose()) if r.random() < 0.1 else self.inline(self.prose())
                out.append(f"{p}{'<b>' if r.random() < 0.1 else ''}{MARK}{text}{r.choice(['</p>', '</p>', '</p>', '', '<br>'])}")
            elif x < 0.80:
                out.append(f"<h{r.randint(2, 4)}>{MARK}{self.sentence(1, 7).rstrip('.')}</h2>")
            elif x < 0.86:
                out.append("<ul>" + "".join(f"<li>{MARK}{self.inline(self.sentence(1, 14))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.89:
                out.append(f"<blockquote>{MARK}{self.prose(2)}</blockquote>")
            elif x < 0.92:
                out.append("<table>" + "".join(f"<tr><td>{MARK}{self.word()}</td><td>{MARK}{self.sentence(1, 5)}</td></tr>" for _ in range(3)) + "</table>")
            elif x < 0.94:
                out.append(f"<pre>{MARK}{self.sentence()}</pre>")
            elif x < 0.96:
                out.append(f"<figure><img src=x><figcaption>{MARK}{self.sentence()}</figcaption></figure>")
            elif x < 0.98:
                out.append(f"<div>{MARK}{self.prose()}</div>")
            else:
                out.append(self.other(r.choice(["advert", "share", "aside", "notice", "form"])))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        before = [self.other(k) for k in ("notice", "header", "menu", "advert", "form") if r.random() < 0.55]
        after = [self.other(k) for k in ("share", "aside", "comments", "form", "advert", "menu", "notice", "footer") if r.random() < 0.45]
        r.shuffle(before)
        if r.random() < 0.5:
            r.shuffle(after)
        if r.random() < 0.25:
            before.append(self.other("aside"))
        tag = r.choice(["article", "article", "article", "main", "div", "div", "section", "td", ""])
        inner = self.article()
        if r.random() < 0.25:  # foreign parts inside of the container
            inner += "".join(self.other(r.choice(["comments", "comments", "share", "aside", "form", "advert"])) for _ in range(r.randint(1, 2)))
        if tag == "td":
            body = f"<table><tr><td{self.names(['sidebar', 'menu', 'left', 'nav'], 0.9)}>{''.join(before)}</td><td{self.names(CONTAINERS, 0.8)}>{inner}</td></tr></table>"
            before = []
        elif tag:
            body = f"<{tag}{self.names(CONTAINERS, 0.5 if tag in ('article', 'main') else 0.85)}>{inner}</{tag}>"
        else:
            body = inner
        if r.random() < 0.3:
            body = f"<main{self.names(CONTAINERS + PLAIN, 0.4)}>{body}{after.pop(0) if after and r.random() < 0.4 else ''}</main>"
        page = "".join(before) + body + "".join(after)
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            page = f"<div{self.names(PLAIN, 0.8)}>{page}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.sentence()}</title><style>p{{}}</style></head><body>{page}</body></html>"
