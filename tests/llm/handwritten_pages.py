"""Pages written by hand, not by the generator that the extractor is fitted on, each with its main text."""

PAGES = [
    (
        """<html lang=en><head><meta charset=utf-8><title>Bridge reopens - Daily</title><style>p{color:red}</style></head><body>
<div id="top"><div class="logo"><a href="/">Daily</a></div><ul class="menu"><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li><li><a href="/w">Weather</a></li></ul></div>
<div class="breadcrumbs"><a href="/">Home</a> &gt; <a href="/n">News</a></div>
<div class="story"><h1>Bridge reopens after two years</h1>
<p>The old bridge over the river was opened to traffic on Monday, two years after a flood had damaged its piers.</p>
<p>Engineers said that the repairs had cost less than planned, and that the new bearings should last for at least fifty years.</p>
<div class="share-bar"><a href="#">Tweet</a> <a href="#">Mail</a></div>
<p>&ldquo;We are glad to have it back,&rdquo; the mayor told a small crowd. Buses will cross it again from next week.</p></div>
<div class="related"><h3>More stories</h3><ul><li><a href="/1">Tunnel plan dropped</a></li><li><a href="/2">Ferry gets new engine</a></li></ul></div>
<div class="footer"><p>&copy; 2024 Daily. <a href="/imprint">Imprint</a> <a href="/terms">Terms of use</a></p></div></body></html>""",
        "Bridge reopens after two years The old bridge over the river was opened to traffic on Monday, two years after a flood had damaged its piers. Engineers said that the repairs had cost less than planned, and that the new bearings should last for at least fifty years. \u201cWe are glad to have it back,\u201d the mayor told a small crowd. Buses will cross it again from next week.",
    ),
    (
        """<!DOCTYPE html><html><body><header role=banner><h2><a href=/>Kitchen notes</a></h2><nav><a href=/r>Recipes</a><a href=/a>About me</a></nav></header>
<main><article class="hentry post-18"><h1 class="entry-title">Bread without kneading</h1>
<div class="entry-content"><p>Mix flour, water, salt and a little yeast in the evening, cover the bowl and leave it on the table overnight.
<p>In the morning the dough has doubled. Fold it twice, let it rest for an hour, and heat a pot in the oven.
<h2>What you need</h2><ul><li>Four cups of flour, sifted</li><li>Two cups of water, not too cold</li></ul>
<p>Bake it for half an hour with the lid on, then for ten minutes without it.</div></article>
<section id="comments"><h3>3 comments</h3><ol class="commentlist"><li><p>Tried it, loved it. Thank you so much for this one!</p></li><li><p>Mine was too wet, what did I do wrong?</p></li></ol>
<form action="/c" method=post><p>Leave a reply</p><textarea></textarea><button>Post comment</button></form></section></main>
<aside><h4>Latest</h4><p><a href=/p1>Soup</a><p><a href=/p2>Salad</a></aside><footer><p>Powered by something</p></footer></body></html>""",
        "Bread without kneading Mix flour, water, salt and a little yeast in the evening, cover the bowl and leave it on the table overnight. In the morning the dough has doubled. Fold it twice, let it rest for an hour, and heat a pot in the oven. What you need Four cups of flour, sifted Two cups of water, not too cold Bake it for half an hour with the lid on, then for ten minutes without it.",
    ),
    (
        """<html><body bgcolor=white><table width="100%"><tr><td class="navcol" width=120><a href=a.html>Start</a><br><a href=b.html>Pictures</a><br><a href=c.html>Guest book</a></td>
<td><h1>Our trip to the lakes</h1><p>We left early on a Friday, before the sun was up, with two tents and far too many socks.</p>
<p>The first lake was so still that the hills stood in it upside down; nobody wanted to be the one to throw a stone.</p>
<p>On the way home it rained, of course, and the smaller tent turned out to be a sieve.</p></td></tr></table>
<div class="disclaimer">All pictures are ours. Best viewed with any browser.</div></body></html>""",
        "Our trip to the lakes We left early on a Friday, before the sun was up, with two tents and far too many socks. The first lake was so still that the hills stood in it upside down; nobody wanted to be the one to throw a stone. On the way home it rained, of course, and the smaller tent turned out to be a sieve.",
    ),
    (
        """<html><head><title>x</title></head><body class="docs"><div class="cookie-banner" role="dialog"><p>This site uses cookies to make it better. By going on you agree.</p><button>Accept</button></div>
<div class="wrapper"><div class="sidebar-left"><ul><li><a href="#i">Install</a></li><li><a href="#u">Use</a></li><li><a href="#f">Faults</a></li></ul></div>
<div class="content"><h1>How the pump works</h1><p>A membrane is moved by a rod; at each stroke a valve lets in as much water as the other lets out.</p>
<blockquote><p>Do not run it dry, as the membrane is cooled by what it moves.</p></blockquote>
<h2>Faults</h2><p>If it hums without moving water, open the upper valve and look for sand, which is the cause nine times out of ten.</p>
<div class="advertisement"><p>Pumps at half price! Order today and save big.</p></div>
<p>A torn membrane shows as drops below the housing; it can be replaced without tools.</p></div></div>
<div id="newsletter"><form><label>Your mail</label><input name=m><button>Subscribe</button></form></div></body></html>""",
        "How the pump works A membrane is moved by a rod; at each stroke a valve lets in as much water as the other lets out. Do not run it dry, as the membrane is cooled by what it moves. Faults If it hums without moving water, open the upper valve and look for sand, which is the cause nine times out of ten. A torn membrane shows as drops below the housing; it can be replaced without tools.",
    ),
    (
        """<html><body><nav class="navbar"><ul><li><a href=/>Accueil</a><li><a href=/c>Contact</a></ul></nav><div class="page"><div class="post-body"><h1>Le marché du samedi</h1>
<p>Dès six heures, les étals se montent sur la place ; les fromages arrivent les premiers, les fleurs en dernier.</p><p>Vers midi, il ne reste que des pommes, quelques poireaux et beaucoup de conversations, que personne ne presse.</p></div>
<div class="tags"><a href=/t/1>marché</a> <a href=/t/2>ville</a></div></div><div class="site-footer"><p>Mentions légales</p><p>Tous droits réservés</p></div></body></html>""",
        "Le marché du samedi Dès six heures, les étals se montent sur la place ; les fromages arrivent les premiers, les fleurs en dernier. Vers midi, il ne reste que des pommes, quelques poireaux et beaucoup de conversations, que personne ne presse.",
    ),
]
