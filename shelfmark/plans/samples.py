"""Small product pages of our own, one per shape that pages take, and what is on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LD_JSON = """<html><head><title>Pine Stool | Grainhouse</title><meta property="og:site_name" content="Grainhouse"><link rel="canonical" href="https://shop.example.com/p/pine-stool-4471"></head>
<body><nav aria-label="breadcrumb"><a href="/">Home</a><a href="/furniture">Furniture</a><a href="/furniture/stools">Stools</a></nav>
<script type="application/ld+json">{"@type":"Product","name":"Pine Stool","sku":"4471","brand":{"@type":"Brand","name":"Grainhouse"},"description":"A three-legged stool of oiled pine.",
"image":["https://cdn.example.com/img/4471-a_1200x1200.jpg","https://cdn.example.com/img/4471-b_1200x1200.jpg"],
"offers":{"@type":"Offer","price":"89.00","priceCurrency":"EUR","availability":"https://schema.org/InStock","shippingDetails":{"@type":"OfferShippingDetails","shippingRate":{"value":"4.90","currency":"EUR"}}}}</script>
<h1>Pine Stool</h1><p class="price">89,00 &euro; <del class="was-price">109,00 &euro;</del></p><button>Add to cart</button></body></html>"""

SELLERS = """<html><head><title>Trail Lamp</title></head><body><h1>Trail Lamp</h1>
<script type="application/ld+json">{"@type":"Product","name":"Trail Lamp","brand":"Northlight","description":"A head lamp for long nights outside.","image":"https://cdn.example.com/img/lamp-77.jpg",
"offers":{"@type":"AggregateOffer","lowPrice":"31.00","highPrice":"45.00","priceCurrency":"USD","offers":[
{"@type":"Offer","price":"31.00","availability":"https://schema.org/OutOfStock"},{"@type":"Offer","price":"42.50","availability":"https://schema.org/InStock"},{"@type":"Offer","price":"39.00","priceCurrency":"USD"}]}}</script></body></html>"""

STATE = """<html><head><title>Wool Cap – Hatters</title></head><body><h1>Wool Cap</h1>
<script>window.__DATA__ = {product: {name: 'Wool Cap', brand: "Hatters", price: 24.5, currency: 'GBP', description: "Knitted from undyed wool.", images: ["https://cdn.example.com/img/cap-1.jpg", "https://cdn.example.com/img/cap-2.jpg"], options: ["Color", "Size"],
variants: [{sku: "C-GR-S", option1: "Grey", option2: "S", available: true, price: 24.5}, {sku: "C-GR-M", option1: "Grey", option2: "M", available: false, price: 24.5}, {sku: "C-NA-S", option1: "Navy", option2: "S", available: true, price: 26}], later: compute(1, "}")}};</script></body></html>"""

MICRODATA = """<html><head><title>Clay Jug</title></head><body><div itemscope itemtype="http://schema.org/Product"><h1 itemprop="name">Clay Jug</h1>
<span itemprop="brand" itemscope itemtype="http://schema.org/Brand"><span itemprop="name">Kiln Row</span></span><p itemprop="description">Thrown by hand, glazed inside only.</p>
<img itemprop="image" src="https://cdn.example.com/img/jug-1.jpg"><div itemprop="offers" itemscope itemtype="http://schema.org/Offer"><meta itemprop="priceCurrency" content="GBP"><span itemprop="price" content="36.00">£36</span></div></div></body></html>"""

ANSWERS = """<html><head><title>Rain Coat</title></head><body><h1>Rain Coat</h1>
<script type="application/json">{"item":{"name":"Rain Coat","price":"120.00","currency":"USD","sku":"RC","description":"Waxed cotton with taped seams.","image":"https://cdn.example.com/img/coat.jpg"},
"questions":[{"label":"Color","answers":[{"label":"Black","skus":["RC-1","RC-2"]},{"label":"Olive","skus":["RC-3"]}]},{"label":"Length","answers":[{"label":"Short","skus":["RC-1","RC-3"]},{"label":"Long","skus":["RC-2","RC-9"]}]}]}</script></body></html>"""

NO_PRICE = """<html><head><title>Marble Table</title></head><body><h1>Marble Table</h1><script type="application/ld+json">{"@type":"Product","name":"Marble Table","brand":"Quarry","description":"Price on request for every size.","image":"https://cdn.example.com/img/table.jpg"}</script>
<div class="shipping-note">Delivery from $49</div></body></html>"""

SHELL = "<html><head><title>Loading… | Example Store</title></head><body><div id=app></div></body></html>"

GALLERY = """<html><head><title>Field Bag</title><link rel="preload" as="image" href="https://cdn.example.com/img/bag-2_600x600.jpg"><meta property="og:image" content="https://cdn.example.com/img/bag-1_1200x1200.jpg"></head>
<body><main><script type="application/ld+json">{"@type":"Product","name":"Field Bag","brand":"Canvas Co","sku":"FB8","description":"Waxed canvas bag with two straps."}</script><h1>Field Bag</h1>
<div class="gallery"><img data-src="https://cdn.example.com/img/bag-1_600x600.jpg" src="data:image/gif;base64,R0lGOD"><img srcset="https://cdn.example.com/img/bag-2_300x300.jpg 300w, https://cdn.example.com/img/bag-2_1200x1200.jpg 1200w"></div>
<video src="https://cdn.example.com/v/bag.mp4"></video><div class="related-products"><img src="https://cdn.example.com/img/other.jpg"><span class="price">$9</span></div><p class="price">$140.00</p><p>Buy now</p></main></body></html>"""

# --- Pages of application frameworks: one carrier each. ---
CALLED = """<html><head><title>Oak Shelf | Plankworks</title></head><body><h1>Oak Shelf</h1><script>window.__STATE__=(function(a,b){return {product:{name:"Oak Shelf",brand:a,price:75,currency:"EUR",sku:"OS1",description:"One board of oak, two pins.",image:"https://cdn.example.com/img/shelf.jpg"},later:b}}("x",1));</script></body></html>"""

PARSED = r"""<html><head><title>Tin Mug</title></head><body><h1>Tin Mug</h1><script>var d = JSON.parse('{"product":{"name":"Tin Mug","brand":"Campfire","price":"9.50","currency":"USD","sku":"TM","description":"Enamelled, chips with grace.","image":"https://cdn.example.com/img/mug.jpg"}}');</script></body></html>"""

PROPS = """<html><head><title>Felt Hat</title></head><body><h1>Felt Hat</h1><div data-product='{"name":"Felt Hat","brand":"Brim","price":44,"currency":"GBP","sku":"FH","description":"Blocked by steam.","image":"https://cdn.example.com/img/hat.jpg"}'></div>
<div data-more="{&quot;note&quot;:&quot;entity escaped&quot;}"></div></body></html>"""

FLIGHT = r"""<html><head><title>Rope Mat</title></head><body><h1>Rope Mat</h1><script>self.__f=self.__f||[];self.__f.push([1,"4:[\"$\",\"div\",null,{\"product\":{\"name\":\"Rope Mat\",\"brand\":{\"name\":\"Quay\"},\"sku\":\"RM\",\"description\":\"Spliced from old line.\",\"offers\":{\"price\":\"30.00\",\"priceCurrency\":\"USD\"},\"image\":[\"https://cdn.example.com/img/mat.jpg\"]}}]"])</script></body></html>"""

RDFA = """<html><head><title>Salt Jar</title></head><body><div vocab="http://schema.org/" typeof="Product"><h1 property="name">Salt Jar</h1><span property="brand">Saltern</span><p property="description">Cork lid, no glaze inside.</p><img property="image" src="https://cdn.example.com/img/jar.jpg">
<div property="offers" typeof="Offer"><meta property="priceCurrency" content="EUR"><span property="price" content="18.00">18 euros</span></div></div></body></html>"""

NORMALISED = """<html><head><title>Reed Basket</title></head><body><h1>Reed Basket</h1><script type="application/json">{"Product:77":{"id":"Product:77","name":"Reed Basket","brand":{"__ref":"Brand:5"},"price":"52.00","currency":"USD","sku":"RB","mediaId":"Media:9","description":"Woven tight enough for seed."},
"Brand:5":{"id":"Brand:5","name":"Marsh & Co","best":{"__ref":"Product:77"}},"Media:9":{"id":"Media:9","url":"https://cdn.example.com/img/basket.jpg"}}</script></body></html>"""

ROWS = """<html><head><title>Trail Sock</title><link rel="canonical" href="https://shop.example.com/p/trail-sock-88"></head><body><h1>Trail Sock</h1><script type="application/json">{"product":{"name":"Trail Sock","brand":"Footpath","price":"14.00","currency":"USD","sku":"TS88","description":"Ribbed merino, knitted double at heel and toe.",
"images":["https://cdn.example.com/img/trail-sock-88-a.jpg","https://cdn.example.com/img/trail-sock-88-b.jpg"],"media":{"mediaType":"VIDEO","url":"https://clips.example.com/v/trail-sock-88.mp4"},
"skus":[{"sku":"88-1","selectedOptions":[{"name":"Size","value":"S"},{"name":"Color","value":"Moss"}],"price":"14.00","currency":"USD","image":{"url":"https://cdn.example.com/img/moss.jpg"},"available":true},
{"sku":"88-2","attributes":{"Size":"M","Color":"Clay"},"price":"15.00","currency":"USD","image":{"url":"https://cdn.example.com/img/clay.jpg"},"quantity":0}]}}</script></body></html>"""

#: A page of many JSON islands.
ISLANDS = "<html><head><title>Bolt Set</title></head><body><h1>Bolt Set</h1>" + "".join(f'<script type="application/json">{{"part":{{"name":"Bolt {i}","image":"https://cdn.example.com/img/bolt-{i}.jpg"}}}}</script>' for i in range(200)) + "</body></html>"

FRAMEWORK_PAGES = {21: CALLED, 22: PARSED, 23: PROPS, 24: FLIGHT, 25: RDFA, 26: NORMALISED, 27: ROWS, 28: ISLANDS}
PAGES = {1: LD_JSON, 2: SELLERS, 3: STATE, 4: MICRODATA, 5: ANSWERS, 6: NO_PRICE, 7: SHELL, 8: GALLERY}
CATEGORIES = ("Furniture > Chairs > Stools", "Furniture > Tables > Dining Tables", "Outdoor > Lighting > Head Lamps", "Apparel > Hats > Caps", "Apparel > Coats > Rain Coats", "Kitchen > Serving > Jugs", "Apparel > Bags > Field Bags")


def sample_pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, f"page-{i}.html", h) for i, h in PAGES.items()], "page_id long, source string, html string")


def framework_pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, f"page-{i}.html", h) for i, h in FRAMEWORK_PAGES.items()], "page_id long, source string, html string")


def sample_taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, i) for i, p in enumerate(CATEGORIES)], "path string, ord int")
