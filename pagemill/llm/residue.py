"""Template residue, filler, error pages and script notices (problem 4).

Character n-gram models of error notices, filler, script notices and natural prose are fitted
from short seed texts in fourteen languages and from all documents. The log
likelihood ratio of a residue model against prose, averaged over windows of characters, localises
residue; a page is excluded when residue covers most of its main body (``main_content``). Unfilled
placeholders are told by their syntax, which a final exact grammar checks.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.batches import map_arrow
from pagemill.functions.blocks import COMMENT, _ATTRS, body_markup, split_blocks, title_text, without_code
from pagemill.llm.encoding import BigramModel, Repairer, mass_scale
from pagemill.llm.encoding import fit as fit_letters
from pagemill.llm.main_content import MAIN, Labeller
from pagemill.llm.main_content import fit_all as fit_field

#: Seed texts, written for the purpose.
ERROR_SEEDS = """
Page not found. The page you requested could not be found. The address you asked for does not exist or has moved. 404 Not Found
Access denied. You do not have permission to view this page. 403 Forbidden. Your request was blocked by the security policy
Service temporarily unavailable. 503 Service Unavailable. The server is down for maintenance, we will be back shortly. Please try again later
Something went wrong on our side. An unexpected error occurred. Internal server error. 500. Oops! We are sorry
Too many requests from your network. Wait a moment and reload. Rate limit exceeded. 429
Your session has expired, please sign in again. You must be logged in. Bad gateway. The server answered with a bad gateway message. 502 Bad Gateway. Gateway timeout
Fatal error: Uncaught Exception in /srv/www/index.php:12 Stack trace: #0 {main} thrown. Warning: include(): failed to open stream. Traceback (most recent call last). SQLSTATE[HY000]: General error. NullPointerException at
Seite nicht gefunden. Die gewünschte Adresse gibt es nicht mehr. Die angeforderte Seite wurde nicht gefunden. Zugriff verweigert. Sie haben keine Berechtigung
Der Dienst ist vorübergehend nicht verfügbar. Wartungsarbeiten. Bitte versuchen Sie es später erneut. Es ist ein Fehler aufgetreten. Zu viele Anfragen. Ihre Sitzung ist abgelaufen
Página no encontrada. La dirección solicitada ya no está disponible. La página que busca no existe. Acceso denegado. No tiene permiso
Servicio temporalmente fuera de línea. El servicio no está disponible. Estamos en mantenimiento. Vuelva a intentarlo más tarde. Se ha producido un error. Demasiadas solicitudes. Su sesión ha caducado
Page introuvable. L’adresse demandée n’existe plus. La page demandée est introuvable. Accès refusé. Vous n’avez pas l’autorisation
Le service est momentanément indisponible. Site en maintenance. Veuillez réessayer plus tard. Une erreur est survenue. Trop de requêtes. Votre session a expiré
Страница не найдена. Запрошенный адрес больше не существует. Запрошенная страница не существует. Доступ запрещён. У вас нет прав
Сервис временно недоступен. Ведутся технические работы. Повторите попытку позже. Произошла ошибка. Слишком много запросов. Сеанс истёк, войдите снова. Внутренняя ошибка сервера
Nie znaleziono strony. Podany adres już nie istnieje. Odmowa dostępu. Brak uprawnień. Usługa jest chwilowo niedostępna. Przerwa techniczna. Spróbuj ponownie później. Wystąpił błąd. Zbyt wiele żądań. Sesja wygasła
Stránka nenalezena. Požadovaná adresa už neexistuje. Přístup odepřen. Služba je dočasně nedostupná. Probíhá údržba. Zkuste to později. Došlo k chybě. Příliš mnoho požadavků. Relace vypršela
Pagina non trovata. L’indirizzo richiesto non esiste più. Accesso negato. Servizio temporaneamente non disponibile. Manutenzione in corso. Riprova più tardi. Si è verificato un errore. Troppe richieste. Sessione scaduta
Página não encontrada. O endereço pedido já não existe. Acesso negado. Serviço temporariamente indisponível. Em manutenção. Tente novamente mais tarde. Ocorreu um erro. Demasiados pedidos. A sessão expirou
Сторінку не знайдено. Запитана адреса більше не існує. Доступ заборонено. Сервіс тимчасово недоступний. Спробуйте пізніше. Сталася помилка. Забагато запитів. Сеанс завершено
找不到页面。您访问的地址不存在或已移动。拒绝访问。您没有权限。服务暂时不可用。系统维护中，请稍后再试。发生错误。请求过多。会话已过期，请重新登录。服务器内部错误
Sidan hittades inte. Adressen finns inte längre. Åtkomst nekad. Tjänsten är tillfälligt otillgänglig. Underhåll pågår. Försök igen senare. Ett fel inträffade. För många förfrågningar. Sessionen har gått ut
Pagina niet gevonden. Het gevraagde adres bestaat niet meer. Toegang geweigerd. De dienst is tijdelijk niet beschikbaar. Onderhoud. Probeer het later opnieuw. Er is een fout opgetreden. Te veel verzoeken. Uw sessie is verlopen
ページが見つかりません。指定されたアドレスは存在しません。アクセスが拒否されました。権限がありません。現在サービスを利用できません。メンテナンス中です。しばらくしてから再度お試しください。エラーが発生しました。リクエストが多すぎます。セッションの有効期限が切れました
"""
SCRIPT_SEEDS = """
You need to enable JavaScript to run this app. This page works only with scripts switched on. Please turn on JavaScript in your browser. JavaScript is required. JavaScript is disabled
Checking your browser before you continue. Please allow scripts and cookies. Enable JavaScript and cookies to continue. Verifying that you are human
Bitte aktivieren Sie JavaScript, um diese Anwendung zu nutzen. Ohne Skripte kann diese Seite nicht angezeigt werden. JavaScript ist erforderlich
Active JavaScript para usar esta aplicación. Esta página necesita que los scripts estén permitidos. Habilite JavaScript
Veuillez activer JavaScript pour utiliser cette application. Cette page exige que les scripts soient autorisés. JavaScript est nécessaire
Включите JavaScript, чтобы пользоваться приложением. Для этой страницы нужны включённые скрипты. Разрешите сценарии в браузере
Włącz obsługę JavaScript, aby korzystać z aplikacji. Ta strona wymaga włączonych skryptów
Pro použití aplikace povolte JavaScript. Tato stránka vyžaduje zapnuté skripty
Attiva JavaScript per usare questa applicazione. Questa pagina richiede gli script abilitati
Ative o JavaScript para usar esta aplicação. Esta página exige scripts ativos
Увімкніть JavaScript, щоб користуватися застосунком. Для цієї сторінки потрібні ввімкнені скрипти
请启用脚本功能后再使用本应用。本页需要启用 JavaScript 才能显示。请在浏览器中打开脚本
Aktivera JavaScript för att använda appen. Sidan kräver att skript är påslagna
Schakel JavaScript in om deze toepassing te gebruiken. Deze pagina vereist scripts
このアプリを使うにはスクリプトを有効にしてください。このページを表示するには JavaScript が必要です。ブラウザーの設定でスクリプトを許可してください
"""
FILLER_SEEDS = """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam, eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo. Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit. Nullam nonummy sediam quisto venim animi
Your text here. Describe the topic in two or three sentences. Insert your text here. Add your content here. Sample text. Click to edit this paragraph. This is dummy text
Placeholder copy for this section, to be replaced. Placeholder text for the caption. Replace this text with your own. Content goes here. Headline goes here. To be written
test test test text asdf asdf xxx xxx blah blah blah foo foo foobar qwerty test text blah asdf xxx
Hier steht Ihr Text. Blindtext. Dies ist ein Platzhaltertext. Text hier einfügen. Beispieltext, bitte ersetzen
Su texto aquí. Texto de ejemplo. Texto de relleno. Escriba aquí su contenido. Votre texte ici. Texte d’exemple à remplacer. Faux texte
Ваш текст здесь. Пример текста. Текст-заполнитель, замените его. Tutaj wpisz tekst. Przykładowy tekst. Zde bude váš text. Ukázkový text. Il tuo testo qui. Testo segnaposto. O seu texto aqui. Texto de exemplo
在此输入文字。示例文本，请替换。ここにテキストを入力してください。ダミーテキストです。サンプルテキスト。Din text här. Exempeltext. Uw tekst hier. Voorbeeldtekst
"""
NATURAL_SEEDS = """
We use cookies to remember your settings and to measure visits. Accept all. Only necessary cookies. Get the newsletter in your inbox. Share this page. Was this article helpful? All rights reserved. Related articles. Last updated on. Privacy policy. Terms of use
Wir verwenden Cookies. Alle Rechte vorbehalten. Nutzungsbedingungen. Nous utilisons des témoins. Tous droits réservés. Usamos cookies. Todos los derechos reservados. Мы используем файлы cookie. Все права защищены
"""

RESIDUE = ("error", "script", "filler")
GRAM = 4
SLOTS = 1 << 18
WINDOW = 24
#: N-grams below which a block is too short to judge.
SHORTEST = 3
#: Mean log-likelihood ratio per n-gram from which a window is residue.
LEVEL = 0.75
#: Share of the main body that residue must cover.
COVERAGE = 0.4
#: Characters judged in one array.
GROUP_CHARS = 1 << 19
#: Blocks whose judgement a task remembers.
REMEMBERED = 200_000

_DIGITS = re.compile("[0-9]+")
_REFERENCE = re.compile(r"^(?:\W*(?:[A-Za-z]+ ){0,2}(?:id:? ?)?[#№]?[0-9a-f-]{3,}\W*|\W*[0-9.]+\W*|.{0,14}[0-9]{3}|.{0,6}!)$", re.I)

#: Placeholder syntaxes of templating languages, and printouts of missing values.
_PLACEHOLDER = re.compile(
    r"\{\{\{?\s*[\w.\-]+(?:\s*[|:]\s*\w+)?\s*\}?\}\}(?<!\|\}\})"  # {{ name }}
    r"|\$\{\s*[\w.\-]+\s*\}|#\{\s*[\w.\-]+\s*\}|\{\$[\w.\->]+\}|\{%-?\s*\w+[^%{}]*%\}|<%[=-]?[^%<>]*%>|<\?(?:php|=)"
    r"|%%[\w.]+%%|(?<![\w%])%[A-Z][A-Z_]+[A-Z]%(?!\w)|<<\s*[\w.]+\s*>>|\*\|[A-Z_:]+\|\*|@@\w+@@|\[%\s*\w+[^%\[\]]*%\]|\(\(\s*\w+\.\w+\s*\)\)"
    r"|(?<![\w{}\\])\{[0-9]\}(?= )(?: of \{[0-9]\})?"  # {0} of {1}
    r"|\[(?:Insert|Your|Enter|Add|Company|First|Last)(?: [\w-]+){0,3}(?: here)?\](?![(\[])"
    r"|\[object \w+\]|\bNaN\b|(?<![\w“\"'`])undefined(?! (?:behavio|variable|index|reference|value))(?=\s*(?:[|,.;:)]|rows|$))|Invalid Date|\bnull null\b|\((?:null|undefined)\)"
)
_WIKI_WORDS = re.compile(r"^\{\{(?:[Rr]eflist|[Cc]lear|[Ss]tub|TOC\w*|[Mm]ain|[Dd]isambig\w*)\}\}$")
_HINT = re.compile(r"[{}%<@\[*]|NaN|undefined|null|Invalid")
_NOSCRIPT = re.compile(r"<noscript(?=[\s/>])(?:" + _ATTRS + r")(.*?)(?:</noscript\s*>|\Z)", re.S | re.I)


def placeholders(text: str) -> list[str]:
    """Unfilled placeholders and printouts of missing values in a piece of text."""
    if not _HINT.search(text):
        return []
    return [m[0] for m in _PLACEHOLDER.finditer(text) if not _WIKI_WORDS.match(m[0]) and not re.match(r"\{\{\{?\s*[A-Z][\w ]*\|", m[0])]


def _hashes(text: str) -> np.ndarray:
    """Slots of a text's character n-grams, case-folded, digit runs as one character."""
    return _codes(" " + _DIGITS.sub("0", text.lower()) + " ")


def _codes(s: str) -> np.ndarray:
    """Slots of the n-grams of a string as it is."""
    a = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(a) < GRAM:
        return np.zeros(0, np.int64)
    h = np.zeros(len(a) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        h = h * np.uint64(1000003) + a[i : len(a) - GRAM + 1 + i] + np.uint64(1)
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % SLOTS


def gram_counts(texts) -> np.ndarray:
    """How often each slot occurs in texts; long texts are cut so that no n-gram is lost."""
    c, group, size = np.zeros(SLOTS, np.int64), [], 0
    for t in texts:
        s = " " + _DIGITS.sub("0", t.lower()) + " "
        for at in range(0, max(1, len(s) - GRAM + 1), GROUP_CHARS):
            group.append(_codes(s[at : at + GROUP_CHARS + GRAM - 1]))
            size += len(group[-1])
            if size > GROUP_CHARS:
                c += np.bincount(np.concatenate(group), minlength=SLOTS)
                group, size = [], 0
    return c + np.bincount(np.concatenate(group), minlength=SLOTS) if group else c


class Ratios:
    """Log-likelihood ratios of each residue model against prose (texts, or their ``gram_counts``), per n-gram slot."""

    def __init__(self, prose: list[str] | np.ndarray, seeds: dict[str, list[str]]):
        counts = gram_counts
        natural = (prose if isinstance(prose, np.ndarray) else counts(prose)) + 20 * counts(NATURAL_SEEDS.strip().split("\n"))
        base = (natural + 0.02) / (natural.sum() + 0.02 * SLOTS)
        self.table = np.zeros((SLOTS, len(RESIDUE)), np.float32)
        for k, kind in enumerate(RESIDUE):
            c = counts(seeds[kind])
            p = (c + 40.0 * base) / (c.sum() + 40.0)
            self.table[:, k] = np.clip(np.log(p / base), -4, 6)

    def windows(self, text: str) -> tuple[int, float]:
        """(kind, share of the text inside residue windows) of a block; kind -1 if none."""
        h = _hashes(text)
        if len(h) < SHORTEST:
            return -1, 0.0
        r = self.table[h]
        n = min(WINDOW, len(h))
        c = np.concatenate([np.zeros((1, r.shape[1])), np.cumsum(r, axis=0, dtype=np.float64)])
        mean = (c[n:] - c[:-n]) / n
        kind = int(mean.max(0).argmax()) if len(mean) < 2 else int((mean > LEVEL).sum(0).argmax())
        hot = np.flatnonzero(mean[:, kind] > LEVEL)
        if not len(hot):
            return -1, 0.0
        mark = np.zeros(len(h) + 1)
        np.add.at(mark, hot, 1)
        np.add.at(mark, np.minimum(hot + n, len(h)), -1)
        return kind, float((np.cumsum(mark[:-1]) > 0).mean())

    def many(self, texts: list[str]) -> list[tuple[int, float]]:
        """``windows`` of many blocks at once: one array of n-grams, whose windows stay inside their blocks."""
        out: list[tuple[int, float]] = [(-1, 0.0)] * len(texts)
        group: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            if len(t) > GROUP_CHARS:
                out[i] = self.windows(t)
                continue
            group.append(i)
            size += len(t)
            if size > GROUP_CHARS:
                self._group(texts, group, out)
                group, size = [], 0
        self._group(texts, group, out)
        return out

    def _group(self, texts: list[str], at: list[int], out: list[tuple[int, float]]) -> None:
        padded = [" " + _DIGITS.sub("0", texts[i].lower()) + " " for i in at]
        length = np.array([len(x) for x in padded], np.int64)
        grams = length - GRAM + 1
        keep = np.flatnonzero(grams >= SHORTEST)
        if not len(keep):
            return
        h = _codes("".join(padded))
        start = np.concatenate([[0], np.cumsum(length)[:-1]])[keep]
        grams = grams[keep]
        c = np.concatenate([np.zeros((1, len(RESIDUE))), np.cumsum(self.table[h], axis=0, dtype=np.float64)])
        n = np.minimum(WINDOW, grams)
        count = grams - n + 1
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        block = np.repeat(np.arange(len(keep)), count)
        lo = np.arange(len(block)) - np.repeat(first, count) + start[block]
        mean = (c[lo + n[block]] - c[lo]) / n[block][:, None]
        kind = np.where(count < 2, mean[first].argmax(1), np.add.reduceat(mean > LEVEL, first, axis=0, dtype=np.int64).argmax(1))
        hot = np.flatnonzero(mean[np.arange(len(block)), kind[block]] > LEVEL)
        mark = np.zeros(len(h) + WINDOW + 1, np.int64)
        np.add.at(mark, lo[hot], 1)
        np.add.at(mark, lo[hot] + n[block[hot]], -1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(mark) > 0)])
        share = (covered[start + grams] - covered[start]) / grams
        for j, k, x in zip(keep.tolist(), kind.tolist(), share.tolist()):
            if x > 0:
                out[at[j]] = (k, x)


def noscript_notice(html: str) -> str:
    """Text of a page's noscript element, '' if there is none."""
    m = _NOSCRIPT.search(COMMENT.sub("", html)) if "noscript" in html.lower() else None
    return " ".join(split_blocks(m[1])) if m else ""


class Judge:
    def __init__(self, ratios: Ratios, labeller: Labeller, repairer: Repairer):
        self.ratios, self.labeller, self.repairer = ratios, labeller, repairer
        self.known: dict[str, tuple[int, float]] = {}

    def blocks(self, texts) -> None:
        """Judge the blocks not known yet, all together; wrongly decoded text is judged by its repaired form."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [t for t in dict.fromkeys(texts) if t not in self.known]
        self.known.update(zip(new, self.ratios.many(new)))
        fixed = {t: f for t in new if self.known[t][0] < 0 and not t.isascii() and (f := self.repairer.repair(t)) != t}
        for t, got in zip(fixed, self.ratios.many(list(fixed.values()))):
            if got[0] >= 0:
                self.known[t] = got

    def block(self, text: str) -> tuple[int, float]:
        """(kind, share) of residue of a block; kind -1 if none."""
        if text not in self.known:
            self.blocks([text])
        return self.known[text]

    def kinds(self, htmls: list[str | None]) -> list[str | None]:
        """Kind of residue of each page, or None. Only pages whose visible text or noscript notice has a residue window are taken apart."""
        out: list[str | None] = [None] * len(htmls)
        texts: list[list[str]] = []
        for i, html in enumerate(htmls):
            if not html:
                texts.append([])
                continue
            markup = body_markup(html)
            blocks = split_blocks(markup)
            plain = split_blocks(without_code(markup)) if "<pre" in markup or "<code" in markup else blocks
            plain = [title_text(html), *plain]
            # No hint spans a line, so one search tells whether any block has one.
            if _HINT.search("\n".join(plain)) and any(map(placeholders, plain)):
                out[i] = "placeholder"
            texts.append([*blocks, noscript_notice(html)])
        self.blocks(x for page in texts for x in page)
        open_ = [i for i, page in enumerate(texts) if any(self.block(x)[1] > 0.3 for x in page)]
        for i, page in zip(open_, self.labeller.pages([htmls[i] for i in open_])):
            kind = self.page_kind(htmls[i], page)
            if kind:
                out[i] = kind
        return out

    def page_kind(self, html: str, page: list[tuple[str, int]]) -> str | None:
        """Kind of a page by the share of its main body that is residue.

        References, bare numbers and the title don't count. A page without any main body is
        told by what notice its remaining blocks or its noscript element hold.
        """
        covered = dict.fromkeys(RESIDUE, 0.0)
        other = 0.0
        title = title_text(html)
        for t in (t for t, r in page if r == MAIN):
            if _REFERENCE.match(t):
                continue
            k, share = self.block(t)
            if k >= 0 and share > 0.3:
                covered[RESIDUE[k]] += len(t) * share
                other += len(t) * (1 - share)
            elif t != title and not title.startswith(t):
                other += len(t)
        total = sum(covered.values()) + other
        if total:
            return max(covered, key=covered.__getitem__) if sum(covered.values()) >= COVERAGE * total else None
        for t, _ in page:
            k, share = self.block(t)
            if k >= 0 and share > 0.8:
                return RESIDUE[k]
        notice = noscript_notice(html)
        return "script" if notice and self.block(notice)[1] > 0.3 else None


def fit(documents: DataFrame) -> tuple[Ratios, BigramModel]:
    """Models from the seeds and all documents, whose n-grams are counted where they are read.

    The counts are scaled to a fixed mass, so the seeds of prose weigh the same however large the table.
    """

    def fn(b, _):
        texts = [t for t in b.column(0).to_pylist() if t]
        c = gram_counts(texts)
        at = np.flatnonzero(c)
        return {"slot": np.append(at, SLOTS), "n": np.append(c[at], len(texts))}

    sums = map_arrow(documents.select("text"), fn, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    prose = np.zeros(SLOTS + 1)
    prose[sums["slot"].to_numpy()] = sums["n"].to_numpy()
    seeds = {"error": ERROR_SEEDS, "script": SCRIPT_SEEDS, "filler": FILLER_SEEDS}
    return Ratios(prose[:-1] * mass_scale(prose[-1]), {k: v.strip().split("\n") for k, v in seeds.items()}), fit_letters(documents)


def residue_pages(cache: DataFrame, documents: DataFrame) -> DataFrame:
    """``page_id, kind`` of pages to exclude; a page whose body is residue takes that kind before 'placeholder'.

    Null and empty html give no row.
    """
    sc = cache.sparkSession.sparkContext
    models, field = sc.broadcast(fit(documents)), sc.broadcast(fit_field(cache))

    def setup() -> Judge:
        ratios, letters = models.value
        return Judge(ratios, Labeller(field.value), Repairer(letters))

    def fn(b, judge: Judge):
        ids, kinds = b.column(0).to_pylist(), judge.kinds(b.column(1).to_pylist())
        keep = [i for i, k in enumerate(kinds) if k]
        return {"page_id": [ids[i] for i in keep], "kind": [kinds[i] for i in keep]}

    return map_arrow(cache.select("page_id", "html"), fn, "page_id bigint, kind string", setup)


def without_residue(cache: DataFrame, documents: DataFrame) -> DataFrame:
    """The rows of ``cache`` that are no residue pages."""
    bad = residue_pages(cache, documents).select("page_id").distinct()
    return cache.join(bad, "page_id", "left_anti")
