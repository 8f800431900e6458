import random

from lattica.llm import html_text as H

PROSE = "The cat and the dog were in the house with a ball that was to be found on the floor of the room, and it is not that far from the other one."
SWEDISH = "Katten och hunden var i huset med en boll som fanns på golvet i rummet, och det är inte så långt från den andra. " * 3
LONG = f"{PROSE} {PROSE}"


def test_languages_without_a_word_list_are_kept():
    assert H.main_text(f"<body><nav><a href=x>Hem</a></nav><div><p>{SWEDISH}</p><p>Kort.</p><p>{SWEDISH}</p></div></body>") == f"{SWEDISH.strip()}\nKort.\n{SWEDISH.strip()}"


def test_names_count_whole():
    for name in ("has-sidebar", "no-comments", "full-search guide", "share-enabled", "toc-style entry", "withSidebar"):
        assert H.main_text(f'<div id="content" class="{name}"><p>{LONG}</p></div>') == LONG
    for name in ("comments", "comment-list", "related-posts", "site-footer", "ad-slot-2", "cookie_notice", "SideBar left sidebar"):
        assert H.main_text(f'<p>{LONG}</p><div class="{name}"><p>{LONG}</p></div>') == LONG
    # names are no more than evidence
    assert H.main_text(f'<div class="related"><p>{LONG}</p></div>') == LONG


def test_forms_around_a_page_are_kept_and_others_dropped():
    assert H.main_text(f'<form action=x><div><p>{LONG}</p><p>{LONG}</p></div></form>') == f"{LONG}\n{LONG}"
    assert H.main_text(f"<form><input><p>{LONG}</p></form><p>{LONG}</p><p>{LONG}</p>") == f"{LONG}\n{LONG}"


def test_scripts_end_at_their_end_tag():
    assert H.main_text(f'<script><!-- var a = "<p>no</p>";</script><article><p>{PROSE}</p><SCRIPT>if (a < b) x("</scripted>")</SCRIPT ><p>{PROSE}</p></article>') == f"{PROSE}\n{PROSE}"


def test_long_blocks_and_empty_pages():
    text = "the word of a page " * 50_000
    assert H.main_text(f"<div><p>{text}</p></div>") == text.strip()
    assert H.main_text("<!-- never closed <p>x</p>") == H.main_text("<p></p>") == H.main_text("<") == ""


def test_empty_table(spark):
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def brute(labels, tags):
    """Second pass over blocks outside of articles, straight from the rule."""
    if not any(x == H.GOOD for x in labels):
        labels = [H.GOOD if x == H.NEAR else x for x in labels]
    out = []
    for k, label in enumerate(labels):
        if label in (H.GOOD, H.BAD):
            out.append(label)
            continue
        decided = [i for i, x in enumerate(labels) if x in (H.GOOD, H.BAD)]
        before, after = max([i for i in decided if i < k], default=None), min([i for i in decided if i > k], default=None)
        near = [i for i in (before, after) if i is not None]
        if label == H.NEAR:
            good = any(labels[i] == H.GOOD for i in near)
        elif tags[k] == "h2":
            good = after is not None and labels[after] == H.GOOD
        else:
            least = min((abs(i - k) for i in near), default=0)
            close = [i for i in near if abs(i - k) == least]
            good = bool(close) and all(labels[i] == H.GOOD for i in close)
        out.append(H.GOOD if good else H.BAD)
    return out


def test_second_pass_equals_brute_force():
    rng = random.Random(5)
    for _ in range(2000):
        n = rng.randint(0, 9)
        tags = [rng.choice(["p", "p", "h2"]) for _ in range(n)]
        labels = [H.SHORT if t == "h2" else rng.choice([H.GOOD, H.BAD, H.NEAR, H.SHORT]) for t in tags]
        found = []
        for tag, label in zip(tags, labels):
            b = H.Block(tag, False, False, 0, 0)
            b.text, b.label = "x" * 50, label
            found.append(b)
        H.second_pass(found)
        assert [b.label for b in found] == brute(labels, tags), (tags, labels)
