"""Hand-written pages of many shapes; ``data-y`` says what is main text (1) and what isn't (0)."""

PAGES = {
    "news with byline and teasers": """<!doctype html><html><head><title>Harbour</title></head><body data-y="0">
<div id="top"><a href="/">The Gazette</a><ul class="nav"><li><a href="/n">News</a><li><a href="/s">Sport</a><li><a href="/w">Weather</a></ul></div>
<div class="story-body" data-y="1"><h1>Harbour bridge to close for repairs</h1>
<p>The old harbour bridge will close on Monday for three weeks, the city council said. Engineers found cracks in two of the pillars during an inspection in spring.</p>
<p>Ferries will run every ten minutes while the bridge is shut. Residents of the north bank can use them free of charge.</p>
<div class="ad-slot" data-y="0"><p>Cheap flights to the south. Book your seat today and save on every ticket.</p></div>
<p>Work on the pillars should be done before the autumn storms, according to the chief engineer.</p></div>
<div class="related" data-y="0"><h3>More stories</h3><ul><li><a href="/1">Council votes on budget</a><li><a href="/2">New school opens in the west</a><li><a href="/3">Storm warning for the coast</a></ul></div>
<div class="footer">Copyright The Gazette. All rights reserved. <a href="/t">Terms</a> <a href="/p">Privacy</a></div></body></html>""",
    "blog post in nameless boxes": """<html><body data-y="0"><div><div><a href="/">Home</a> | <a href="/about">About me</a> | <a href="/archive">Archive</a></div>
<div data-y="1"><h2>How I rebuilt the garden shed</h2><p>Last summer the roof of our garden shed finally gave in. I had put off the work for years, and when the rain came through in June there was no way around it.</p>
<p>First I took down the old boards. Most of them were rotten at the ends, but the beams were still good, so I kept those and sanded them.</p>
<p>The new roof took two weekends. I used larch, which is expensive but lasts, and covered it with felt.</p><p>Next year I want to paint the walls.</p></div>
<div><p>Powered by a small engine. <a href="/rss">Feed</a></p></div></div></body></html>""",
    "layout table": """<HTML><BODY data-y="0"><TABLE><TR><TD colspan=3><IMG src=logo.gif><FONT size=5>Model Railway Club</FONT></TD></TR>
<TR><TD class=menu><A href=a.htm>Start</A><BR><A href=b.htm>Members</A><BR><A href=c.htm>Layouts</A><BR><A href=d.htm>Links</A></TD>
<TD data-y="1"><H1>Our summer exhibition</H1><P>This year the exhibition takes place in the old engine house. Members have been building a new layout since winter, and it will be shown for the first time.<P>Doors open at ten in the morning. Visitors can run their own engines on the large oval in the afternoon.<P>Tea and cake will be served by the ladies of the parish.</TD>
<TD class=sidebar><B>Next meeting</B><BR>Tuesday at eight</TD></TR><TR><TD colspan=3>Webmaster: write to us</TD></TR></TABLE></BODY></HTML>""",
    "documentation": """<html><body data-y="0"><header><a href="/">Toolkit</a><form action="/search"><input name=q><button>Search</button></form></header>
<nav class="toc"><ul><li><a href="#i">Install</a></li><li><a href="#u">Usage</a></li><li><a href="#c">Configuration</a></li><li><a href="#f">Questions</a></li></ul></nav>
<main data-y="1"><h1>Getting started</h1><p>The toolkit reads tables from disk and writes them back in another order. It needs no server.</p><h2>Install</h2><p>Unpack the archive and put the folder on your path.</p><pre>tool init --here
tool run</pre><h2>Usage</h2><p>Call the program with the name of a table. The following options are known:</p><ul><li>quiet: print nothing but errors</li><li>force: overwrite what is there</li></ul><p>Options may be given in any order.</p></main>
<footer><a href="/prev">Previous</a> <a href="/next">Next</a><p>Last built on Friday.</p></footer></body></html>""",
    "post with a comment thread": """<html><body data-y="0"><div id="masthead"><h1>Letters from the coast</h1></div>
<div id="content"><div class="post" data-y="1"><h2>On walking in winter</h2><p>There is a kind of silence on the beach in January that you will not find in any other month. The dogs are gone, the kiosks are shut, and even the gulls seem to speak more quietly.</p><p>I walk for an hour each morning, whatever the weather, and come home with cold hands and a clear head.</p></div>
<div id="comments"><h3>3 comments</h3><ol><li class="comment"><b>Anna</b><p>So true. I did the same last year when we stayed in the village, and I have missed it ever since.</p><ul><li class="comment"><b>Tom</b><p>Me too, though I prefer the woods.</p></li></ul></li><li class="comment"><b>Kim</b><p>Lovely piece, thank you for writing it. Will there be more?</p></li></ol>
<form><textarea></textarea><button>Post comment</button></form></div></div><div id="footer">Theme by somebody</div></body></html>""",
    "wiki with a table": """<html><body data-y="0"><div id="site-header"><a href="/">Almanac</a></div><div id="bodyContent" data-y="1"><h1>Lake Orm</h1><table><tr><th>Area</th><td>12 square kilometres</td></tr><tr><th>Depth</th><td>40 metres</td></tr></table>
<p>Lake Orm is a lake in the northern hills. It is fed by two streams and drained by the river Orm, which leaves it in the south.</p><h2>History</h2><p>The lake was formed after the last ice age. Fishing villages have stood on its shores for some two thousand years.</p><h2>Wildlife</h2><p>Pike, perch and eel live in the lake; ospreys nest on the islands.</p></div>
<div class="sidebar"><ul><li><a href="/m">Main page</a></li><li><a href="/r">Random page</a></li><li><a href="/h">Help</a></li></ul></div><div class="footer"><p>Text is available under a free licence.</p></div></body></html>""",
    "recipe": """<html><body data-y="0"><nav><a href="/">Kitchen</a> <a href="/soups">Soups</a> <a href="/bread">Bread</a></nav><div class="cookie-notice"><p>We use cookies to make this site better. By staying you agree to that.</p><button>Fine</button></div>
<article data-y="1"><h1>Barley soup</h1><p>A thick soup for cold days. It keeps for three days and tastes better on the second.</p><h2>You need</h2><ul><li>200 g of pearl barley</li><li>two carrots</li><li>one leek</li><li>a litre of stock</li></ul><h2>Method</h2><ol><li>Soak the barley overnight.</li><li>Cut the vegetables and fry them gently in butter.</li><li>Add barley and stock, and simmer for an hour.</li></ol></article>
<aside><h3>You may also like</h3><ul><li><a href="/1">Pea soup</a></li><li><a href="/2">Rye bread</a></li></ul></aside><footer>Kitchen, since 2004</footer></body></html>""",
    "bare page": """<html><title>Notes</title><body data-y="1"><h1>Notes on tides</h1><p>Tides are long waves that move through the oceans in answer to the pull of the moon and the sun.<p>Where the crest of the wave reaches a coast there is high tide, and low tide where its trough does.<p>The range between both is largest in narrow bays.""",
    "question and answer": """<html><body data-y="0"><div class="topbar"><a href="/">Ask</a><a href="/tags">Tags</a><a href="/login">Log in</a></div><div class="container"><div class="entry-content" data-y="1"><h1>Why does bread go stale?</h1><p>Bread left on the table gets hard within a day, even when it is wrapped. Why is that, and can it be undone?</p><h2>Answer</h2><p>The starch in the crumb slowly returns to a crystalline form and binds water, which makes the crumb firm. Warming the loaf reverses this for a while.</p><p>Freezing stops the process almost entirely, whereas a refrigerator speeds it up.</p></div>
<div class="newsletter"><form><label>Your address</label><input><button>Subscribe</button></form><p>One letter a week, no more.</p></div></div><div class="site-footer"><ul><li><a href="/a">About</a></li><li><a href="/c">Contact</a></li><li><a href="/l">Legal</a></li></ul></div></body></html>""",
    "press release with broken markup": """<html><body data-y="0"><ul id="navigation"><li><a href=/>Start<li><a href=/press>Press<li><a href=/jobs>Jobs</ul><div class="main-text" data-y="1"><h2>New plant opens in spring<p>The company will open a third plant in March. It is to employ two hundred people and make pumps for the water works of the region<p>"We have waited long for this day," said the head of the board. <b>The building was finished on time<p>Visitors may see the plant on the first Sunday of April</div><div class="disclaimer"><p>Statements about the future may turn out wrong.</div><p class="copyright">Copyright 2020</body>""",
    "product page": """<html><body data-y="0"><header><a href="/">Shop</a><nav><ul><li><a href="/t">Tools</a></li><li><a href="/g">Garden</a></li><li><a href="/s">Sale</a></li></ul></nav></header><div class="wrapper"><section class="content" data-y="1"><h1>Folding saw</h1><p>A light saw for pruning branches up to ten centimetres. The blade folds into the handle and locks in two positions.</p><dl><dt>Blade</dt><dd>hardened steel, 21 centimetres</dd><dt>Weight</dt><dd>230 grams</dd></dl><p>Replacement blades can be ordered separately and are changed without tools.</p></section>
<aside class="recommended"><h2>Others bought</h2><div><a href="/1">Loppers</a></div><div><a href="/2">Work gloves</a></div></aside></div><footer><p>Prices include tax. Delivery within three days.</p><ul><li><a href="/r">Returns</a></li><li><a href="/i">Imprint</a></li></ul></footer></body></html>""",
    "forum thread": """<html><body data-y="0"><div id="header"><h1>Sailing board</h1><div class="breadcrumbs"><a href="/">Index</a> / <a href="/b">Boats</a></div></div><div id="page-body"><div class="entry" data-y="1"><h2>Repairing a wooden mast</h2><p>My mast has a crack of about a foot just above the boom. The wood is spruce and otherwise sound. I am thinking of cutting a scarf joint and gluing in a new piece.</p><p>Has the length of the joint to be twelve times the diameter, as the old books say, or will eight do with modern glue?</p></div><div class="replies"><div class="reply"><p>Twelve, always twelve. I tried eight once and regretted it in the first gale.</p></div><div class="reply"><p>Ten is fine if you use the right glue and clamp it well.</p></div></div></div><div class="footer"><p>Board rules apply to all posts.</p></div></body></html>""",
}
