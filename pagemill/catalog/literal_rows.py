"""Expected columns and rows of the queries over literal pages, typed out and read against the rules of each operator."""

EXPECTED = {
    'lit_outline': (
        'page_id bigint, ord int, level int, title string, id string, parent_ord int',
        [
            (1, 0, 1, 'One', '', None),
            (1, 1, 2, 'One A', 'a', 0),
            (1, 2, 3, 'Deep', '', 1),
            (1, 3, 2, 'One B', '', 0),
            (1, 4, 1, 'Two', '', None),
            (1, 5, 2, 'Two A', '', 4),
        ],
    ),
    'lit_lists': (
        'page_id bigint, list_ix int, ordered boolean, item_ix int, segments string',
        [
            (1, 0, False, 0, 'first'),
            (1, 0, False, 1, 'second|inner'),
            (1, 0, False, 2, 'inner'),
            (1, 1, False, 0, 'inner'),
            (1, 2, True, 0, 'One|bold'),
            (1, 2, True, 1, 'Two'),
        ],
    ),
    'lit_direct_lists': (
        'page_id bigint, list_ix int, ordered boolean, item_ix int, segments string',
        [
            (1, 0, False, 0, 'first'),
            (1, 0, False, 1, 'second|inner'),
            (1, 1, False, 0, 'inner'),
            (1, 2, True, 0, 'One|bold'),
            (1, 2, True, 1, 'Two'),
        ],
    ),
    'lit_tables': (
        'page_id bigint, table_ix int, caption string, row_ix int, cells string, error string',
        [
            (1, 0, 'Prices', 0, '{"Item":"Pear","Cost":"2"}', None),
            (1, 0, 'Prices', 1, '{"Item":"Pear","Cost":"3"}', None),
            (1, 0, 'Prices', 2, '{"Item":"Sum","Cost":"5"}', None),
            (1, 1, '', 0, '{"Column1":"1","Column2":"x","Column3":"x"}', None),
            (1, 1, '', 1, '{"Column1":"2","Column2":"true","Column3":"2024-01-02"}', None),
            (1, 2, '', 0, '{"Name":"a","Name1":"b","Column3":"c"}', None),
        ],
    ),
    'lit_table_heads': (
        'page_id bigint, table_ix int, caption string, id string, classes string, headers string, types string, row_count int, error string',
        [
            (1, 0, 'Prices', 'a', 't u', 'Item|Cost', 'string|bigint', 3, None),
            (1, 1, '', '', '', 'Column1|Column2|Column3', 'bigint|string|string', 2, None),
            (1, 2, '', '', '', 'Name|Name1|Column3', 'string|string|string', 1, None),
        ],
    ),
    'lit_reversed_tables': (
        'page_id bigint, table_ix int, cells string',
        [
            (1, 0, '{"Pear":"2","3":null,"Sum":"5"}'),
            (1, 1, '{"1":"x","2":"true"}'),
            (1, 2, '{"Name":"Name","a":"b"}'),
        ],
    ),
    'lit_forms': (
        'page_id bigint, form_ix int, id string, name string, action string, method string, fields string, successful string, login boolean, relay string',
        [
            (1, 0, 'login', '', 'https://shop.example/login', 'POST', '[{"name":"user","type":"text","value":"ann"},{"name":"pass","type":"password","value":""},{"name":"keep","type":"checkbox","value":"on"},{"name":"no","type":"checkbox","value":"on"},{"name":"","type":"submit","value":""},{"name":"late","type":"text","value":"z"}]', '[{"key":"user","value":"ann"},{"key":"pass","value":""},{"key":"keep","value":"on"},{"key":"late","value":"z"}]', True, None),
            (1, 1, '', '', 'https://shop.example/docs/find', 'GET', '[{"name":"s","type":"select","value":"Two"},{"name":"t","type":"textarea","value":"text"},{"name":"off","type":"text","value":"x"}]', '[{"key":"s","value":"Two"},{"key":"t","value":"text"}]', False, None),
            (1, 2, '', '', 'https://sso.example/acs', 'POST', '[{"name":"SAMLResponse","type":"hidden","value":"abc"}]', '[{"key":"SAMLResponse","value":"abc"}]', False, 'saml'),
        ],
    ),
    'lit_meta': (
        'page_id bigint, name string, source_attribute string, content string',
        [
            (1, 'description', 'name', 'A page'),
            (1, 'og:title', 'property', ' Title '),
            (1, 'og:image', 'property', '/i.png'),
            (1, 'og:image', 'property', '/j.png'),
            (1, 'og:empty', 'property', ''),
            (1, 'refresh', 'http-equiv', '5'),
        ],
    ),
    'lit_open_graph': (
        'page_id bigint, name string, values string',
        [
            (1, 'title', 'Title'),
            (1, 'image', '/i.png|/j.png'),
            (1, 'empty', ''),
        ],
    ),
    'lit_microdata': (
        'page_id bigint, item_ix int, type string, id string, props string',
        [
            (1, 0, 'https://schema.org/Person', '#p', '{"name":["Ann Lee"],"url":["/ann"],"jobTitle":["Reader"],"age":["30"],"address":["Road 1"]}'),
            (1, 1, 'https://schema.org/Product', '', '{"price":["5"]}'),
        ],
    ),
    'lit_microdata_unknown': (
        'page_id bigint, item_ix int, type string, unknown string',
        [
            (1, 0, 'https://schema.org/Person', 'age'),
        ],
    ),
    'lit_head_links': (
        'page_id bigint, tag string, name string, value string, url string, media_type string',
        [
            (1, 'meta', 'description', 'A page', '', ''),
            (1, 'meta', 'og:title', ' Title ', '', ''),
            (1, 'meta', 'og:image', '/i.png', 'https://shop.example/i.png', ''),
            (1, 'meta', 'og:image', '/j.png', 'https://shop.example/j.png', ''),
            (1, 'meta', 'refresh', '5', '', ''),
            (1, 'link', 'canonical', '/docs/page?b=2&a=1#x', 'https://shop.example/docs/page?b=2&a=1#x', ''),
            (1, 'link', 'alternate', 'feed.xml', 'https://shop.example/docs/feed.xml', 'application/rss+xml'),
        ],
    ),
    'lit_canonical': (
        'page_id bigint, url string',
        [
            (1, 'https://shop.example/docs/page?a=1&b=2'),
        ],
    ),
    'lit_links': (
        'page_id bigint, url string, href string, text string, title string, context string, external boolean',
        [
            (1, 'https://shop.example/root/a.html', 'a.html', 'the A', 'the A', 'See the A and other', False),
            (1, 'https://other.example/x#f', 'https://other.example/x#f', 'other', '', 'See the A and other', True),
            (1, 'https://shop.example/root/#top', '#top', 'top', '', 'See the A and othertopmailagainnonebad', False),
            (1, 'mailto:q@e.example', 'mailto:q@e.example', 'mail', '', 'See the A and othertopmailagainnonebad', False),
            (1, 'https://shop.example/root/a.html', 'a.html', 'again', '', 'See the A and othertopmailagainnonebad', False),
            (1, 'https://shop.example/area', '/area', '', '', '', False),
        ],
    ),
    'lit_crawl_links': (
        'page_id bigint, url string',
        [
            (1, 'https://shop.example/root/a.html'),
            (1, 'https://other.example/x'),
            (1, 'https://shop.example/root/'),
            (1, 'https://shop.example/area'),
        ],
    ),
    'lit_images': (
        'page_id bigint, tag string, url string, descriptor string, alt string, best boolean',
        [
            (1, 'img', 'https://shop.example/docs/a.png', '', 'Alt', False),
            (1, 'img', 'https://shop.example/docs/a.png', '1x', 'Alt', False),
            (1, 'img', 'https://shop.example/docs/b.png', '2x', 'Alt', True),
            (1, 'source', 'https://shop.example/docs/c.webp', '400w', '', False),
            (1, 'source', 'https://shop.example/docs/d.webp', '800w', '', True),
            (1, 'img', 'https://shop.example/docs/e.png', '', '', False),
            (1, 'img', 'https://shop.example/docs/ns.png', '', '', False),
            (2, 'link', 'https://shop.example/docs/p.png', '1x', '', False),
            (2, 'link', 'https://shop.example/docs/q.png', '2x', '', True),
        ],
    ),
    'lit_crawl_assets': (
        'page_id bigint, url string, kind string',
        [
            (1, 'https://shop.example/docs/a.png', 'img'),
            (1, 'https://shop.example/docs/b.png', 'srcset'),
            (1, 'https://shop.example/docs/c.webp', 'srcset'),
            (1, 'https://shop.example/docs/d.webp', 'srcset'),
            (1, 'https://shop.example/docs/e.png', 'img'),
            (1, 'https://shop.example/docs/v.mp4', 'video'),
            (1, 'https://shop.example/docs/p.png', 'video'),
            (1, 'https://shop.example/s.js', 'script'),
            (1, 'https://shop.example/docs/s.css', 'link'),
            (1, 'https://shop.example/docs/bg.png', 'css'),
            (1, 'https://shop.example/docs/ns.png', 'img'),
            (1, 'https://frame.example/', 'iframe'),
        ],
    ),
    'lit_resources': (
        'page_id bigint, ord int, type string, source string, inline string, comment string, name string',
        [
            (1, 0, 'script', 'https://shop.example/lib/one.js?v=1', '', 'the library', 'one.js'),
            (1, 1, 'style', 'https://shop.example/docs/css/two.css', '', 'colours', 'two.css'),
            (1, 2, 'style', '', 'a{}', '', ''),
            (1, 3, 'script', '', 'run()', '', ''),
            (1, 4, 'script', '', 'no', '', ''),
        ],
    ),
    'lit_scripts': (
        'page_id bigint, script_ix int, src string, type string, javascript boolean, module boolean, inline_length int',
        [
            (1, 0, 'https://shop.example/lib/one.js?v=1', '', True, False, 0),
            (1, 1, '', 'module', True, True, 5),
            (1, 2, '', 'text/template', False, False, 2),
        ],
    ),
    'lit_javascript': (
        'page_id bigint, script_ix int, name string, value string',
        [
            (1, 0, 'a', '{"x": 1, "y": [true, null], "z": "it\'s"}'),
            (1, 0, 'config', '{"env": "prod", "port": 8080}'),
            (1, 0, 'app.user.name', '"Ann"'),
            (1, 0, 'n', '5'),
            (1, 0, 's', '{"k": [1]}'),
            (1, 2, '__INITIAL_STATE__', '{"on": true, "off": false}'),
        ],
    ),
    'lit_app_state': (
        'page_id bigint, name string, source string, json string',
        [
            (1, '__NEXT_DATA__', 'id', '{"page": "/"}'),
            (1, '__INITIAL_STATE__', 'assignment', '{"on": true, "off": false}'),
        ],
    ),
    'lit_js_config': (
        'page_id bigint, script_ix int, name string, value string',
        [
            (1, 0, 'config', '{"env": "prod", "port": 8080}'),
            (1, 2, '__INITIAL_STATE__', '{"on": true, "off": false}'),
        ],
    ),
    'lit_script_data': (
        'page_id bigint, script_ix int, type string, id string, json string, valid boolean',
        [
            (1, 1, 'application/json', '__NEXT_DATA__', '{"page":"/"}', True),
            (1, 3, 'importmap', '', '{"imports":{}}', True),
            (1, 4, 'application/json', 'bad', '{', False),
        ],
    ),
    'lit_tokens': (
        'page_id bigint, name string, value string, source string',
        [
            (1, 'csrf-token', 'm1', 'meta'),
            (1, '__RequestVerificationToken', 'f1', 'input'),
            (1, 'data-token', 'd1', 'div'),
            (1, 'nonce', 'n1', 'script'),
            (1, 'csrfToken', 's1', 'script'),
            (1, 'xsrf_token', 's2', 'script'),
        ],
    ),
    'lit_endpoints': (
        'page_id bigint, script_ix int, method string, url string, client string, operation string',
        [
            (1, 0, 'GET', '/api/v1/users', 'fetch', ''),
            (1, 0, 'POST', '/api/v1/users', 'fetch', ''),
            (1, 0, 'GET', 'https://other.example/data.json', 'axios', ''),
            (1, 0, 'POST', '/ajax/save', '$', ''),
            (1, 0, 'PUT', '/rest/item?token=1', 'xhr', ''),
            (1, 0, '', '/graphql', 'literal', ''),
        ],
    ),
    'lit_api_inventory': (
        'page_id bigint, kind string, method string, resolved_url string, name string, risk string, reasons string',
        [
            (1, 'form', 'POST', 'https://shop.example/login', 'signin', 'High', 'state-changing|auth'),
            (1, 'javascript', 'POST', 'https://shop.example/ajax/save', '', 'High', 'state-changing'),
            (1, 'javascript', 'POST', 'https://shop.example/api/v1/users', '', 'High', 'state-changing'),
            (1, 'javascript', 'PUT', 'https://shop.example/rest/item?token=1', '', 'High', 'state-changing|sensitive-query|auth'),
            (1, 'javascript', 'GET', 'https://other.example/data.json', '', 'Medium', 'external'),
            (1, 'javascript', '', 'https://shop.example/graphql', '', 'Medium', 'unknown-method'),
            (1, 'javascript', 'GET', 'https://shop.example/api/v1/users', '', 'Low', ''),
        ],
    ),
    'lit_flight_rows': (
        'page_id bigint, row_ix int, id bigint, tag string, data string, json string, complete boolean, payload_ix int',
        [
            (1, 0, 1, '', '{"a":1}', '{"a":1}', True, 0),
            (1, 1, 2, 'T', 'hello', None, True, 0),
            (1, 2, 3, 'I', '["x"]', '["x"]', True, 0),
            (1, 3, 255, '', '"end"', '"end"', True, 1),
        ],
    ),
    'lit_code_blocks': (
        'page_id bigint, block_ix int, language string, code string, lines int, kind string',
        [
            (1, 0, 'json', '{"a": 1}', 1, 'json'),
            (1, 1, '', '$ curl https://e', 1, 'curl'),
            (1, 2, 'http', 'GET /v1/items HTTP/1.1', 1, 'http'),
        ],
    ),
    'lit_breadcrumbs': (
        'page_id bigint, trail_ix int, item_ix int, label string, url string',
        [
            (1, 0, 0, 'Home', 'https://shop.example/'),
            (1, 0, 1, 'Docs', 'https://shop.example/docs'),
            (1, 0, 2, 'Here', ''),
        ],
    ),
    'lit_faq': (
        'page_id bigint, question string, answer string, source string',
        [
            (1, 'Why?', 'Because.', 'details'),
            (1, 'How?', 'So.', 'microdata'),
        ],
    ),
    'lit_spec_tables': (
        'page_id bigint, table_ix int, row_ix int, name string, value string',
        [
            (1, 0, 0, 'Weight', '5 kg'),
            (1, 0, 1, 'Size', '2 m'),
        ],
    ),
    'lit_callouts': (
        'page_id bigint, kind string, title string, text string',
        [
            (1, 'note', 'Mind', 'Mind the gap'),
        ],
    ),
    'lit_layout': (
        'page_id bigint, kind string, tag string, id string, words int, links int, total int',
        [
            (1, 'header', 'header', '', 3, 0, 1),
            (1, 'navigation', 'nav', '', 1, 2, 1),
            (1, 'main', 'main', '', 4, 0, 1),
            (1, 'article', 'article', '', 4, 0, 1),
            (1, 'aside', 'div', '', 1, 0, 1),
            (1, 'footer', 'footer', '', 1, 0, 1),
        ],
    ),
    'lit_actions': (
        'page_id bigint, label string, url string, intent string, score int',
        [
            (1, 'Sign up', '', 'signup', 55),
            (1, 'Buy now', 'https://shop.example/buy', 'buy', 45),
            (1, 'Download', 'https://shop.example/x', 'download', 20),
        ],
    ),
    'lit_doc_endpoints': (
        'page_id bigint, method string, path string, summary string, parameters string, score int, promoted boolean',
        [
            (1, 'GET', '/v1/items', '', '', 40, False),
            (1, 'GET', '/v1/items/{id}', 'Reads one item.', 'id', 80, True),
        ],
    ),
    'lit_statistics': (
        'page_id bigint, words int, links int, images int, elements int, headings int, paragraphs int, tables int, lists int, forms int, scripts int, depth int',
        [
            (1, 28, 4, 0, 28, 1, 1, 1, 0, 0, 0, 4),
            (2, 5, 7, 0, 11, 0, 1, 0, 0, 0, 0, 3),
        ],
    ),
    'lit_text': (
        'page_id bigint, title string, lang string, text string, lines string, markdown string',
        [
            (1, 'Tale', 'en', 'One two three a b x y 1 < 2 next', 'One two three\na\nb\nx\n  y\n1 < 2\nnext', 'One **two** three\n\n- a\n- b\n\n```\nx\n  y\n```\n\n1 < 2  \nnext'),
        ],
    ),
    'lit_readable': (
        'page_id bigint, text string, title string, selector string, score double, candidates int, words int',
        [
            (1, 'Story\ngood words good words good words good words good words good words good words good words good words good words', 'Story', 'article#story', 249.0, 2, 21),
        ],
    ),
    'lit_publication_dates': (
        'page_id bigint, published string, modified string, bound string',
        [
            (1, '2024-03-01', '2024-04-02', None),
        ],
    ),
    'lit_facts': (
        'page_id bigint, ord int, kind string, source_ix int, name string, value string',
        [
            (1, 0, 'meta', 0, 'description', 'A page'),
            (1, 1, 'meta', 1, 'og:title', ' Title '),
            (1, 2, 'meta', 2, 'og:image', '/i.png'),
            (1, 3, 'meta', 3, 'og:image', '/j.png'),
            (1, 4, 'meta', 4, 'og:empty', '""'),
            (1, 5, 'meta', 5, 'refresh', '5'),
            (1, 6, 'open_graph', 0, 'title', '["Title"]'),
            (1, 7, 'open_graph', 1, 'image', '["/i.png", "/j.png"]'),
            (1, 8, 'open_graph', 2, 'empty', '[]'),
            (1, 9, 'head_links', 0, 'description', 'A page'),
            (1, 10, 'head_links', 1, 'og:title', ' Title '),
            (1, 11, 'head_links', 2, 'og:image', 'https://shop.example/i.png'),
            (1, 12, 'head_links', 3, 'og:image', 'https://shop.example/j.png'),
            (1, 13, 'head_links', 4, 'refresh', '5'),
            (1, 14, 'head_links', 5, 'canonical', 'https://shop.example/docs/page?b=2&a=1#x'),
            (1, 15, 'head_links', 6, 'alternate', 'https://shop.example/docs/feed.xml'),
            (1, 16, 'images', 0, 'link', 'https://shop.example/docs/p.png'),
            (1, 17, 'images', 1, 'link', 'https://shop.example/docs/q.png'),
            (2, 0, 'links', 0, 'the A', 'https://shop.example/root/a.html'),
            (2, 1, 'links', 1, 'other', 'https://other.example/x#f'),
            (2, 2, 'links', 2, 'top', 'https://shop.example/root/#top'),
            (2, 3, 'links', 3, 'mail', 'mailto:q@e.example'),
            (2, 4, 'links', 4, 'again', 'https://shop.example/root/a.html'),
            (2, 5, 'links', 5, 'https://shop.example/area', 'https://shop.example/area'),
        ],
    ),
    'lit_plan': (
        'page_id bigint, mode string, confidence string, words int, links int, forms int, scripts int',
        [
            (1, 'RenderedSnapshot', 'Medium', 0, 0, 0, 3),
            (2, 'AuthRequired', 'High', 0, 0, 1, 0),
            (3, 'Static', 'High', 90, 0, 0, 0),
            (4, 'Relay', 'High', 1, 0, 3, 1),
        ],
    ),
    'lit_json_ld': (
        'page_id bigint, item_ix int, type string, name string, raw string, error boolean',
        [
            (1, 0, 'Article', 'A', '{"@type": "Article", "name": "A", "url": "https://shop.example/docs/page", "datePublished": "2024-03-01"}', False),
            (1, 1, 'Thing,Place', '', '{"@type": ["Thing", "Place"]}', False),
            (1, 2, 'Event', 'E', '{"@type": "Event", "name": "E"}', False),
            (1, 3, '', '', '{"broken":', True),
        ],
    ),
    'lit_audit': (
        'page_id bigint, code string, severity string, message string, element string',
        [
            (1, 'document-title-missing', 'Warning', 'The document does not define a non-empty title.', 'head'),
            (1, 'document-language-missing', 'Warning', 'The document root does not declare a language.', 'html'),
            (1, 'duplicate-id', 'Error', "The id 'd' is used by 2 elements.", '#d'),
            (1, 'image-alt-missing', 'Error', 'The image does not define an alt attribute. Use an empty alt value for decorative images.', 'img'),
            (1, 'interactive-name-missing', 'Error', 'The interactive element has no accessible name.', 'button#d'),
            (1, 'interactive-name-missing', 'Error', 'The interactive element has no accessible name.', 'a#d'),
            (1, 'form-label-missing', 'Error', 'The form control has no associated label or accessible name.', 'input#u'),
            (1, 'unsafe-url-scheme', 'Error', 'The href attribute uses an executable URL scheme.', 'a#d'),
            (1, 'heading-level-skipped', 'Warning', 'Heading hierarchy jumps from h1 to h3.', 'h3'),
        ],
    ),
    'lit_compatibility': (
        'page_id bigint, rule_id string, severity string, message string, selector string, element string, attribute string, value string',
        [
            (1, 'duplicate-id', 'Error', "Duplicate id 'box'.", 'div#box', 'div', 'id', 'box'),
            (1, 'duplicate-id', 'Error', "Duplicate id 'box'.", 'div#box', 'div', 'id', 'box'),
            (1, 'missing-img-alt', 'Warning', 'Image is missing an alt attribute.', 'img', 'img', 'alt', 'a b.png'),
            (1, 'empty-label', 'Warning', 'Label has no readable text.', 'label', 'label', None, None),
            (1, 'label-target-missing', 'Error', "Label references missing id 'none'.", 'label', 'label', 'for', 'none'),
            (1, 'label-target-invalid', 'Error', "Label references non-labelable id 'box'.", 'label', 'label', 'for', 'box'),
            (1, 'form-field-missing-label', 'Warning', 'Form field has no associated label or accessible name.', 'input', 'input', None, 'n'),
            (1, 'form-field-missing-label', 'Warning', 'Form field has no associated label or accessible name.', 'button', 'button', None, None),
            (1, 'empty-inline-style', 'Info', 'Element has an empty inline style attribute.', 'div#box', 'div', 'style', None),
            (1, 'invalid-resource-url', 'Error', "Asset URL 'a b.png' could not be resolved.", 'img', 'img', 'src', 'a b.png'),
            (1, 'invalid-resource-url', 'Error', "Asset URL ' ' could not be resolved.", 'link', 'link', 'href', ' '),
        ],
    ),
    'lit_select_elements': (
        'page_id bigint, node_id int, tag string, id string, classes string, text string, html string, attributes string',
        [
            (1, 4, 'a', '', '', 'more', '<a href="/p/1">more</a>', '{"href":"/p/1"}'),
            (1, 11, 'a', '', '', 'more', '<a href="/p/2">more</a>', '{"href":"/p/2"}'),
            (1, 18, 'a', '', '', 'more', '<a href="/p/3">more</a>', '{"href":"/p/3"}'),
            (1, 22, 'p', '', '', 'Plain text', '<p>Plain <i>text</i></p>', '{}'),
        ],
    ),
    'lit_select_values': (
        'page_id bigint, node_id int, value string',
        [
            (1, 4, 'https://shop.example/p/1'),
            (1, 11, 'https://shop.example/p/2'),
            (1, 18, 'https://shop.example/p/3'),
        ],
    ),
    'lit_select_own_text': (
        'page_id bigint, node_id int, value string',
        [
            (1, 22, 'Plain'),
            (1, 26, 'Other text'),
        ],
    ),
    'lit_select_by_text': (
        'page_id bigint, node_id int, tag string, id string, classes string, text string, attributes string',
        [
            (1, 26, 'p', '', 'x', 'Other text', '{"class":"x"}'),
        ],
    ),
    'lit_select_similar': (
        'page_id bigint, node_id int, selector string, score int, text string',
        [
            (1, 8, 'div:nth-of-type(2)', 100, 'Beemore$2'),
            (1, 15, 'div:nth-of-type(3)', 100, 'Catmore$3'),
        ],
    ),
    'lit_select_relocated': (
        'page_id bigint, rank int, selector string, score int, confidence string, text string',
        [
            (1, 1, 'div:nth-of-type(1)', 100, 'Medium', 'Apemore$1'),
            (1, 2, 'div:nth-of-type(2)', 100, 'Medium', 'Beemore$2'),
            (1, 3, 'div:nth-of-type(3)', 100, 'Medium', 'Catmore$3'),
        ],
    ),
    'lit_select_records': (
        'page_id bigint, item_ix int, title string, link string, price string, none string',
        [
            (1, 0, 'Ape', 'https://shop.example/p/1', '$1', None),
            (1, 1, 'Bee', 'https://shop.example/p/2', '$2', None),
            (1, 2, 'Cat', 'https://shop.example/p/3', '$3', None),
        ],
    ),
    'lit_record_report': (
        'field string, items bigint, filled bigint, coverage double, status string',
        [
            ('title', 3, 3, 100.0, 'Complete'),
            ('price', 3, 3, 100.0, 'Complete'),
            ('none', 3, 0, 0.0, 'MissingRequired'),
        ],
    ),
    'lit_recipe': (
        'page_id bigint, item_ix int, t string',
        [
            (1, 0, 'Ape'),
            (1, 1, 'Bee'),
            (1, 2, 'Cat'),
        ],
    ),
    'lit_recipe_drift': (
        'shape string, change string',
        [
            ('link,title', 'added'),
        ],
    ),
    'lit_collections': (
        'page_id bigint, rank int, selector string, items int, fields string, score int, confidence string',
        [
            (1, 1, 'div.card', 3, 'link|price|span|title', 108, 'Medium'),
        ],
    ),
    'lit_style_rules': (
        'id bigint, rule_ix int, selector string, property string, value string, important boolean, condition string, specificity string',
        [
            (1, 0, '#a .b p:hover, i', 'color', 'red', True, '', '1|2|1'),
            (1, 0, '#a .b p:hover, i', '--main', '1px', False, '', '1|2|1'),
            (1, 1, 'a[href]', 'b', "url('x.png')", False, '@media print', '0|1|1'),
        ],
    ),
    'lit_style_variables': (
        'id bigint, selector string, property string, value string',
        [
            (1, '#a .b p:hover, i', '--main', '1px'),
        ],
    ),
    'lit_style_usage': (
        'page_id bigint, rule_ix int, selector string, matches int, elements string',
        [
            (1, 0, '.card > p, p.x', 2, 'div > p|p'),
            (1, 1, 'a', 0, ''),
        ],
    ),
    'lit_dom_nodes': (
        'page_id bigint, pre int, last_pre int, parent_pre int, depth int, tag string, attributes string, own_text string, sibling_ix int',
        [
            (1, 1, 2, 0, 1, 'style', '{}', '.card > p, p.x { color: red !important; --main: 1px } @media print { a { b: c } }', 0),
            (1, 3, 5, 0, 1, 'div', '{"class":"card"}', '', 1),
            (1, 4, 5, 3, 2, 'p', '{}', 'a', 0),
            (1, 6, 7, 0, 1, 'p', '{"class":"x"}', 'b', 2),
        ],
    ),
    'lit_content_selection': (
        'page_id bigint, mode string, reason_code string, reason string, tag string, id string, classes string, selector_hint string, score double, candidates int, root_hint string, words int',
        [
            (1, 'Focused', 'FocusedSemanticFallback', 'Focused mode fell back to semantic content element <article.post.wide>.', 'article', '', 'post|wide', 'article.post.wide', None, 0, None, 31),
            (2, 'Focused', 'FocusedFullDocumentFallback', 'Focused mode kept the full document because no preferred content element was found.', None, None, '', None, None, 0, None, 3),
            (3, 'Focused', 'FocusedSemanticFallback', 'Focused mode fell back to semantic content element <main#m>.', 'main', 'm', '', 'main#m', None, 0, None, 30),
            (1, 'Reader', 'ReaderBestCandidate', 'Reader mode started from document body and selected the best-scoring content block <article.post.wide> with score 122.', 'article', '', 'post|wide', 'article.post.wide', 122.0, 4, 'body', 31),
            (2, 'Reader', 'ReaderRootFallback', 'Reader mode started from document body and kept <body> because no stronger article-like candidate met the minimum score of 25.', 'body', '', '', 'body', None, 2, 'body', 3),
            (3, 'Reader', 'ReaderBestCandidate', 'Reader mode started from document body and selected the best-scoring content block <section> with score 108.', 'section', '', '', 'section', 108.0, 3, 'body', 80),
            (1, 'Raw', 'RawSelector', "Raw mode selected the exact configured selector 'article'.", 'article', '', 'post|wide', 'article.post.wide', None, 0, None, 31),
            (2, 'Raw', 'RawSelectorMiss', "Raw mode produced no stored content because selector 'article' was not found.", None, None, '', None, None, 0, None, 0),
            (3, 'Raw', 'RawSelectorMiss', "Raw mode produced no stored content because selector 'article' was not found.", None, None, '', None, None, 0, None, 0),
            (1, 'Focused', 'FocusedSelector', "Focused mode selected the configured selector '#wrap'.", 'div', 'wrap', '', 'div#wrap', None, 0, None, 31),
            (2, 'Focused', 'FocusedFullDocumentFallback', "Focused mode kept the full document because selector '#wrap' did not match and no semantic fallback was found.", None, None, '', None, None, 0, None, 3),
            (3, 'Focused', 'FocusedFullDocumentFallback', "Focused mode kept the full document because selector '#wrap' did not match and no semantic fallback was found.", None, None, '', None, None, 0, None, 110),
        ],
    ),
    'lit_content_comparison': (
        'page_id bigint, mode string, reason_code string, score double, candidates int, selector_hint string, words int, characters int, summary string',
        [
            (1, 'Raw', 'RawDocument', None, 0, None, 31, 169, 'Head alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta'),
            (1, 'Focused', 'FocusedSemanticFallback', None, 0, 'article.post.wide', 31, 169, 'Head alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta'),
            (1, 'Reader', 'ReaderBestCandidate', 122.0, 4, 'article.post.wide', 31, 169, 'Head alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta'),
            (2, 'Raw', 'RawDocument', None, 0, None, 3, 14, 'few words only'),
            (2, 'Focused', 'FocusedFullDocumentFallback', None, 0, None, 3, 14, 'few words only'),
            (2, 'Reader', 'ReaderRootFallback', None, 2, 'body', 3, 14, 'few words only'),
            (3, 'Raw', 'RawDocument', None, 0, None, 110, 549, 'word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word more text more text more text...'),
            (3, 'Focused', 'FocusedSemanticFallback', None, 0, 'main#m', 30, 149, 'word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word'),
            (3, 'Reader', 'ReaderBestCandidate', 108.0, 3, 'section', 80, 399, 'more text more text more text more text more text more text more text more text more text more text more text more text more text more text more text more text more text more text...'),
        ],
    ),
    'lit_content_winners': (
        'page_id bigint, best string, reason_code string, words int, runner_up string, delta int, deltas string',
        [
            (1, 'Reader', 'ReaderBestCandidate', 31, 'Focused', 0, 'Reader 0 | Focused 0 | Raw 0'),
            (2, 'Reader', 'ReaderRootFallback', 3, 'Focused', 0, 'Reader 0 | Focused 0 | Raw 0'),
            (3, 'Raw', 'RawDocument', 110, 'Reader', 30, 'Raw 0 | Reader -30 | Focused -80'),
        ],
    ),
    'lit_page_reader': (
        'page_id bigint, title string, headings string, paragraphs string, lists int, tables string, links string, forms int, regions string, words int',
        [
            (1, 'Head', 'Head', 'alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta alpha beta|secret', 0, '', '[{"text":"one link","url":"https://shop.example/docs/1"},{"text":"two link","url":"https://shop.example/docs/2"},{"text":"three link","url":"https://shop.example/docs/3"}]', 0, 'navigation|article', 31),
            (2, '', '', '', 0, 'Item|Cost|Column1|Column2|Column3|Name|Name1|Column3', '[]', 0, '', 19),
        ],
    ),
    'lit_dataset_chunks': (
        'page_id bigint, chunk_id string, chunk_index int, source_url string, title string, words int, characters int, headings string, forms int, redaction_hints string, provenance string',
        [
            (1, 'page-chunk-0001', 0, 'https://shop.example/docs/page', '', 2, 13, '', 3, 'hidden-form-fields|login-form|browserless-auth-relay', ''),
            (2, 'page-chunk-0001', 0, 'https://shop.example/docs/page', '', 50, 283, '', 0, '', ''),
            (2, 'page-chunk-0002', 1, 'https://shop.example/docs/page', '', 40, 225, '', 0, '', ''),
        ],
    ),
    'lit_sensitive_parameters': (
        'id bigint, redacted string',
        [
            (1, 'https://<redacted>@e.example/a?b=1&access_token=<redacted>#state=<redacted>&c=2'),
            (2, '/p?monkey=1&api_key=<redacted>'),
            (3, 'https://e.example/plain'),
        ],
    ),
    'lit_robots_directives': (
        'id bigint, line int, directive string, value string, group bigint, agents string',
        [
            (1, 2, 'user-agent', '*', 1, '*'),
            (1, 3, 'disallow', '/private', 1, '*'),
            (1, 4, 'allow', '/private/ok', 1, '*'),
            (1, 6, 'user-agent', 'Botty', 2, 'botty|other'),
            (1, 7, 'user-agent', 'Other', 2, 'botty|other'),
            (1, 8, 'disallow', '', 2, 'botty|other'),
            (1, 9, 'crawl-delay', '5', 2, 'botty|other'),
            (1, 10, 'sitemap', 'https://shop.example/s.xml', 2, 'botty|other'),
        ],
    ),
    'lit_robots_rules': (
        'id bigint, allow boolean, pattern string, agent string',
        [
            (1, False, '/private', 'any'),
            (1, True, '/private/ok', 'any'),
            (1, False, '', 'botty'),
        ],
    ),
    'lit_robots_verdict': (
        'url string, allowed boolean',
        [
            ('https://o.example/private', True),
            ('https://shop.example/', True),
            ('https://shop.example/a.pdf', False),
            ('https://shop.example/a.pdf?x', True),
            ('https://shop.example/private/ok/1', True),
            ('https://shop.example/private/x', False),
        ],
    ),
    'lit_sitemaps': (
        'id bigint, url string, lastmod string, is_sitemap boolean',
        [
            (1, 'https://shop.example/A', '2024-03-01 00:00:00', False),
            (1, 'https://shop.example/b', None, False),
            (1, 'https://shop.example/a', None, False),
            (2, 'https://shop.example/s2.xml', '2024-01-01 08:00:00', True),
        ],
    ),
    'lit_sitemap_urls': (
        'url string',
        [
            ('https://shop.example/A',),
            ('https://shop.example/b',),
        ],
    ),
    'lit_feeds': (
        'file bigint, item_ix int, feed string, title string, url string, guid string, summary string, published string, updated string, author string, categories string',
        [
            (1, 0, 'News', 'A b', 'https://shop.example/a', 'g1', 'd', '2024-03-01 10:00:00', None, '', 'x|y'),
            (2, 0, 'At', 'T', 'https://shop.example/t', 'u1', 's', '2024-03-02 00:00:00', '2024-03-03 00:00:00', 'Ann', 'z'),
        ],
    ),
    'lit_manifests': (
        'id bigint, name string, short_name string, start_url string, scope string, display string, theme_color string, icons string, screenshots string, related_applications string',
        [
            (1, 'App', 'A', '/', None, 'standalone', None, '[{"src":"i.png","sizes":"48x48"}]', None, None),
            (2, None, None, None, None, None, None, None, None, None),
        ],
    ),
    'lit_well_known': (
        'id bigint, line int, section string, name string, value string',
        [
            (1, 1, None, 'Contact', 'mailto:a@e.example'),
            (1, 3, None, 'Expires', '2025-01-01'),
            (2, 2, 'TEAM', 'Dev', 'Ann'),
            (2, 3, 'TEAM', None, 'free text'),
        ],
    ),
    'lit_ads_entries': (
        'id bigint, line int, domain string, account string, relation string, authority string',
        [
            (1, 2, 'ads.example', '12', 'DIRECT', 'f0'),
            (1, 3, 'other.example', '9', 'RESELLER', None),
        ],
    ),
    'lit_har_entries': (
        'id bigint, entry_ix int, started string, method string, url string, status int, content_type string, size bigint, millis double',
        [
            (1, 0, '2024-03-01 10:00:00', 'GET', 'https://e.example/a', 200, 'application/json', 10, 12.5),
            (1, 1, None, 'POST', 'https://e.example/b', 404, 'text/html', None, None),
        ],
    ),
    'lit_network_data_sources': (
        'id bigint, entry_ix int, url string, content_type string',
        [
            (1, 0, 'https://e.example/a', 'application/json'),
        ],
    ),
    'lit_netscape_cookies': (
        'id bigint, name string, value string, domain string, path string, expires bigint, http_only boolean, secure boolean, same_site string',
        [
            (1, 'sid', 'abc', '.e.example', '/', 1700000000, False, True, None),
            (1, 'k', 'v w', 'e.example', '/a', 0, True, False, None),
        ],
    ),
    'lit_netscape_export': (
        'value string',
        [
            ('.e.example\tTRUE\t/\tTRUE\t1700000000\tsid\tabc',),
            ('#HttpOnly_e.example\tFALSE\t/a\tFALSE\t0\tk\tv w',),
        ],
    ),
    'lit_set_cookies': (
        'id bigint, name string, value string, domain string, path string, expires bigint, http_only boolean, secure boolean, same_site string',
        [
            (1, 'sid', 'a=b', 'e.example', '/x', 1709251200, True, True, 'Lax'),
            (2, 'k', 'v', None, '/', None, False, False, None),
            (3, None, None, None, None, None, None, None, None),
            (4, None, None, None, None, None, None, None, None),
        ],
    ),
    'lit_browser_cookies': (
        'id bigint, name string, value string, domain string, path string, expires bigint, http_only boolean, secure boolean, same_site string',
        [
            (1, 'a', '1', '.e.example', '/', 1700000000, True, False, 'lax'),
            (2, 'b', '2', None, None, 5, None, None, None),
        ],
    ),
    'lit_saml_responses': (
        'id bigint, issuer string, status string, destination string, subject_present boolean, audiences string, not_before string, not_after string, attributes string',
        [
            (1, 'idp', 'Success', 'https://sp.example/acs', True, 'sp', '2024-01-01T00:00:00Z', '2024-01-02T00:00:00Z', 'mail'),
            (2, 'idp', 'Success', 'https://sp.example/acs', True, 'sp', '2024-01-01T00:00:00Z', '2024-01-02T00:00:00Z', 'mail'),
        ],
    ),
    'lit_json_web_tokens': (
        'id bigint, algorithm string, issuer string, subject string, expires string, issued string, not_before string',
        [
            (1, 'HS256', 'idp', 'u1', '2023-11-14 22:13:20', '2020-09-13 12:26:40', None),
            (2, None, None, None, None, None, None),
            (3, None, None, None, None, None, None),
        ],
    ),
    'lit_json_shapes': (
        'id bigint, shape string',
        [
            (1, '{a:{c:null},b:[number|string]}'),
            (2, '[]'),
        ],
    ),
    'lit_decoded_bytes': (
        'id bigint, tail string',
        [
            (1, 'Größe'),
            (2, 'Größe'),
            (3, '">Сеть'),
            (4, 'é'),
            (5, None),
            (6, '">Сеть'),
        ],
    ),
    'lit_web_dates': (
        'id bigint, instant string',
        [
            (1, '2024-03-01 00:00:00'),
            (2, '2024-03-01 00:00:00'),
            (3, '2024-03-01 10:20:30'),
            (4, '2024-03-01 08:20:00'),
            (5, '2024-03-01 10:00:00'),
            (6, '2024-03-01 09:00:00'),
            (7, '1994-03-01 15:00:00'),
            (8, '2024-03-01 10:30:00'),
            (9, '2024-03-01 00:00:00'),
            (10, '2024-03-01 00:00:00'),
            (11, '2024-03-01 00:00:00'),
            (12, '2024-03-01 00:00:00'),
            (13, '2024-03-01 00:00:00'),
            (14, '2024-03-01 00:00:00'),
            (15, None),
            (16, None),
        ],
    ),
    'lit_page_names': (
        'id bigint, slug string, table_name string, hash string',
        [
            (1, '0001-my-first-page', 'My_First_Page_', 'c04dcf1bd5b78051127747bed1c8ebe7'),
            (2, '0002-page', '_', 'cb3f91d54eee30e53e35b2b99905f70f'),
            (3, '0003-aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa', 'aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa', '11ee391211c6256460b6ed375957fadd'),
            (4, '0004-ber-uns-2', 'Über_uns_2', 'c6833af730758fc22769581cabd7409b'),
        ],
    ),
    'lit_summaries': (
        'id bigint, summary string, words int, plain string',
        [
            (1, 'short text', 2, 'short  text'),
            (2, 'word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word...', 60, 'word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word '),
            (3, 'xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx...', 1, 'xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx'),
        ],
    ),
    'lit_csv_fields': (
        'id bigint, field string',
        [
            (1, 'plain'),
            (2, '"say ""hi"""'),
            (3, '"a,b"'),
            (4, '"two\nlines"'),
        ],
    ),
    'lit_json_lines': (
        'value string',
        [
            ('{"id":1,"content":"a","url":"https://shop.example/docs/page"}',),
            ('{"id":2,"content":"b\\"","url":"https://shop.example/docs/page"}',),
        ],
    ),
    'lit_page_differences': (
        'page_id bigint, kind string, path string, before string, after string',
        [
            (1, 'attribute', '/p[0]@class', 'a', 'b'),
            (1, 'changed', '/p[0]/#text[0]', 'one', 'two'),
            (1, 'added', '/ul[1]/li[1]', None, '<li>y</li>'),
            (3, 'added', '/b[0]', None, '<b>new</b>'),
        ],
    ),
    'lit_transform_markdown': (
        'page_id bigint, result string',
        [
            (1, '# T\n\na **b** *c* [l](/x)\n\n- 1\n- 2\n\n```py\nx = 1\n```\n\n| h |\n| --- |\n| v |\n\n> q\n\n![A](i.png)'),
        ],
    ),
    'lit_transform_text': (
        'page_id bigint, result string',
        [
            (1, 'ab c'),
            (2, ''),
        ],
    ),
    'lit_transform_lines': (
        'page_id bigint, result string',
        [
            (1, 'a\nb\nc\nx\n  y'),
        ],
    ),
    'lit_transform_format_html': (
        'page_id bigint, result string',
        [
            (1, '<div>\n  <p>a <b>b</b></p>\n  <ul>\n    <li>x</li>\n  </ul>\n</div>'),
        ],
    ),
    'lit_transform_minify_html': (
        'page_id bigint, result string',
        [
            (1, '<div><p> a </p><pre> k </pre></div>'),
        ],
    ),
    'lit_transform_format_css': (
        'page_id bigint, result string',
        [
            (1, 'a {\n  b: c;\n  d: e;\n}\n@media print {\n  i {\n    f: g;\n  }\n}'),
        ],
    ),
    'lit_transform_minify_css': (
        'page_id bigint, result string',
        [
            (1, "a{b :c;content:' x '}i>p{d:e}"),
        ],
    ),
    'lit_transform_redact_url': (
        'page_id bigint, result string',
        [
            (1, 'https://<redacted>@e.example/a?b=1&access_token=<redacted>#state=<redacted>&c=2'),
            (2, '/p?next=https%3A%2F%2Fo.example%2F%3Ftoken%3D%3Credacted%3E'),
            (3, '/p?monkey=1&myToken=<redacted>)'),
            (4, 'https://e.example/plain'),
            (5, ''),
        ],
    ),
    'lit_transform_redact_structured': (
        'page_id bigint, result string',
        [
            (1, 'var appToken = <redacted>; cfg = {"api_key": "<redacted>", "name": "n", state: "<redacted>"}; go("https://e.example/?code=<redacted>")'),
            (2, 'plain'),
        ],
    ),
    'lit_transform_redact_links': (
        'page_id bigint, result string',
        [
            (1, 'see [a](/p?token=<redacted>) and ![b](i.png)'),
        ],
    ),
    'lit_transform_inline_css': (
        'page_id bigint, result string',
        [
            (1, '<p style="color:red">a</p><p class="k" style="color:blue;margin:0">b</p>'),
        ],
    ),
    'lit_transform_entity_decode': (
        'page_id bigint, result string',
        [
            (1, 'a < b & c é'),
        ],
    ),
    'lit_transform_entity_encode': (
        'page_id bigint, result string',
        [
            (1, 'a &lt; b &amp; &#x27;c&#x27;'),
        ],
    ),
    'lit_sql_functions': (
        'page_id bigint, t string, heads string, u string, n string',
        [
            (1, 'Ape more$1 Bee more$2 Cat more$3 Plain text Other text', 'Ape|Bee|Cat', 'https://shop.example/x', 'http://e.example/a'),
        ],
    ),
    'lit_nested_objects': (
        'page_id bigint, kind string, node_path string, parent_path string, ordinal int, attributes string',
        [
            (1, 'Items', 'Items[0]', '', 0, '{"Name":"a"}'),
            (1, 'Data', 'Items[0].Data[0]', 'Items[0]', 0, '{"X":1}'),
            (1, 'Data', 'Items[0].Data[2]', 'Items[0]', 2, '{"X":1}'),
            (1, 'Items', 'Items[1]', '', 1, '{"Name":"a"}'),
            (1, 'Data', 'Items[1].Data[0]', 'Items[1]', 0, '{"X":1}'),
            (2, 'Items', 'Items[0]', '', 0, '{}'),
        ],
    ),
    'lit_surface': (
        'page_id bigint, ord int, kind string, name string, method string, url string, value string',
        [
            (1, 0, 'Token', 'csrf-token', '', '', 'm1'),
            (1, 1, 'Token', '__RequestVerificationToken', '', '', 'f1'),
            (1, 2, 'Token', 'data-token', '', '', 'd1'),
            (1, 3, 'Token', 'nonce', '', '', 'n1'),
            (1, 4, 'Token', 'csrfToken', '', '', 's1'),
            (1, 5, 'Token', 'xsrf_token', '', '', 's2'),
            (2, 0, 'Form', 'form[0]', 'POST', 'https://shop.example/login', ''),
            (2, 1, 'Endpoint', 'fetch', 'GET', '/api/v1/users', ''),
            (2, 2, 'Endpoint', 'fetch', 'POST', '/api/v1/users', ''),
            (2, 3, 'Endpoint', 'axios', 'GET', 'https://other.example/data.json', ''),
            (2, 4, 'Endpoint', '$', 'POST', '/ajax/save', ''),
            (2, 5, 'Endpoint', 'xhr', 'PUT', '/rest/item?token=1', ''),
            (2, 6, 'Endpoint', 'literal', '', '/graphql', ''),
            (3, 0, 'Form', 'login', 'POST', 'https://shop.example/login', ''),
            (3, 1, 'Form', 'form[1]', 'GET', 'https://shop.example/docs/find', ''),
            (3, 2, 'Form', 'form[2]', 'POST', 'https://sso.example/acs', ''),
            (3, 3, 'Field', 'SAMLResponse', '', '', 'abc'),
        ],
    ),
    'lit_members': (
        'page_id bigint, script_ix int, path string, n int',
        [
            (1, 0, 'a', 1),
            (1, 0, 'window.config', 1),
            (1, 0, 'app', 1),
            (1, 0, 'n', 1),
            (1, 0, 's', 1),
            (1, 0, 'JSON.parse', 1),
            (1, 0, 'f', 1),
            (1, 0, 'call', 1),
            (1, 2, 'window.__INITIAL_STATE__', 1),
            (2, 0, 'fetch', 3),
            (2, 0, 'axios.get', 1),
            (2, 0, '$.post', 1),
            (2, 0, 'd', 1),
            (2, 0, 'x.open', 1),
            (2, 0, 'q', 1),
        ],
    ),
    'lit_data_sources': (
        'page_id bigint, kind string, name string, size int, found_ix int',
        [
            (1, 'app_state', '__INITIAL_STATE__', 26, 1),
            (1, 'app_state', '__NEXT_DATA__', 13, 0),
            (1, 'script_data', 'importmap', 14, 3),
            (1, 'script_data', '__NEXT_DATA__', 12, 2),
            (2, 'json_ld', 'Article', 105, 0),
            (2, 'json_ld', 'Event', 31, 2),
            (2, 'json_ld', 'Thing,Place', 29, 1),
            (2, 'script_data', 'application/ld+json', 139, 3),
            (2, 'script_data', 'application/ld+json', 30, 4),
            (3, 'table', 'Prices', 3, 0),
            (3, 'table', '', 2, 1),
            (3, 'table', '', 1, 2),
        ],
    ),
    'lit_transform_minify_js': (
        'page_id bigint, result string',
        [
            (1, 'var a=1;function f(b){return b+ ++a}\nlet r=/a b/g.test(`x ${ f(1) } y`)\nf(2)'),
        ],
    ),
    'lit_transform_format_js': (
        'page_id bigint, result string',
        [
            (1, "function f(a){\n    if(a){\n        return [1,2];\n    }\n    else{\n        x='{;}'\n    }\n}\nvar y=1;\nfor(let i=0;i<2;i++){\n    f(i)\n}"),
        ],
    ),
    'lit_xpath': (
        'page_id bigint, ord int, node_id int, tag string, value string, expression string',
        [
            (1, 0, None, None, '/p/2', "//div[@class='card'][2]/a/@href"),
            (1, 0, 20, 'span', '$3', "//h3[text()='Cat']/following-sibling::span"),
            (1, 0, 23, None, 'Plain ', "//p[not(@class)]/text() | //p[contains(., 'Other')]"),
            (1, 1, 26, 'p', 'Other text', "//p[not(@class)]/text() | //p[contains(., 'Other')]"),
            (1, 0, 16, 'h3', 'Cat', '//div[last()]/h3'),
            (2, 0, 23, 'td', '2', "//td[position() > 1 and . != 'x']"),
            (2, 1, 37, 'td', 'true', "//td[position() > 1 and . != 'x']"),
            (2, 2, 39, 'td', '2024-01-02', "//td[position() > 1 and . != 'x']"),
            (2, 3, 51, 'td', 'b', "//td[position() > 1 and . != 'x']"),
            (2, 4, 53, 'td', 'c', "//td[position() > 1 and . != 'x']"),
            (2, 0, None, None, 'a', '//caption/parent::table/@id'),
            (1, 0, 2, 'h3', 'Ape', "//div[count(a) = 1 and starts-with(h3, 'A')]/h3"),
        ],
    ),
    'lit_selectors_for': (
        'page_id bigint, rank int, selector string, matches int',
        [
            (1, 1, 'p.x', 1),
            (1, 2, 'i', 1),
            (1, 3, 'p:nth-of-type(1) > i', 1),
            (1, 4, 'p:nth-of-type(2)', 1),
            (1, 5, 'p', 2),
        ],
    ),
    'lit_typed_fields': (
        'id bigint, price double, count tinyint, on boolean, day string, letter string, failed string',
        [
            (1, 1234.5, 7, True, '2024-03-01 00:00:00', 'x', ''),
            (2, None, -1, None, None, None, 'price|count|on|letter'),
            (3, None, 12, None, None, None, 'letter'),
        ],
    ),
    'lit_property_paths': (
        'id bigint, deep string, shallow string, typed string',
        [
            (1, 'x', '{"b":[{"c":5},{"c":"x"}]}', '{"a":{"b":[{"c":"5"},{"c":"x"}]}}'),
            (2, None, None, '{}'),
            (3, None, '1', '{}'),
        ],
    ),
    'lit_json_schemas': (
        'kind string, schema string, records bigint',
        [
            ('k', '{"properties": {"a": {"type": "number"}, "b": {"items": {"properties": {"c": {"type": ["null", "string"]}, "d": {"type": "boolean"}}, "required": ["c"], "type": "object"}, "type": "array"}}, "required": ["a", "b"], "type": "object"}', 2),
            ('one', '{"properties": {"a": {"type": "null"}}, "required": ["a"], "type": "object"}', 1),
        ],
    ),
    'lit_openapi_documents': (
        'host string, document string, operations bigint',
        [
            ('shop.example', '{"openapi":"3.0.3","info":{"title":"Shop","version":"1.0.0"},"paths":{"/v1/items":{"post":{"summary":"Adds.","parameters":[],"responses":{"200":{"description":"Success"}}}},"/v1/items/{id}":{"get":{"summary":"Reads one item.","parameters":[{"name":"id","in":"path","required":true,"schema":{"type":"string"}}],"responses":{"200":{"description":"Success"}}}}}}', 2),
        ],
    ),
    'lit_linked_endpoints': (
        'script_url string, page_id bigint, method string, url string, client string, operation string',
        [
            ('https://shop.example/s.js', 1, 'GET', '/api/x', 'fetch', ''),
        ],
    ),
    'lit_embedded_images': (
        'page_id bigint, html string',
        [
            (1, '<p><img src="data:image/png;base64,YWJj"><img src="b.png"></p>'),
            (2, None),
        ],
    ),
    'lit_graph_histograms': (
        'facet string, value string, n bigint',
        [
            ('relation', 'fetched', 2),
            ('source_host', 'a.example', 3),
            ('target_host', 'a.example', 2),
            ('relation', 'external', 1),
            ('target_host', 'b.example', 1),
        ],
    ),
    'lit_graph_export': (
        'part string, value string',
        [
            ('node', '{"url":"https://a.example/","in_degree":1,"out_degree":2,"internal_out":1}'),
            ('node', '{"url":"https://a.example/x","in_degree":1,"out_degree":1,"internal_out":1}'),
            ('node', '{"url":"https://b.example/","in_degree":1,"out_degree":0,"internal_out":0}'),
            ('edge', '{"source":"https://a.example/","target":"https://a.example/x","relation":"fetched"}'),
            ('edge', '{"source":"https://a.example/","target":"https://b.example/","relation":"external"}'),
            ('edge', '{"source":"https://a.example/x","target":"https://a.example/","relation":"fetched"}'),
        ],
    ),
    'lit_html_index': (
        'url string, item string',
        [
            ('https://e.example/?a=1&b=2', '<li><a href="https://e.example/?a=1&amp;b=2">A &lt;b&gt;</a> <span>Success</span></li>'),
            ('https://e.example/n', '<li><a href="https://e.example/n">https://e.example/n</a> <span></span></li>'),
        ],
    ),
    'lit_har_export': (
        'id bigint, log string',
        [
            (1, '{"log":{"version":"1.2","entries":[{"request":{"method":"POST","url":"https://e.example/b"},"response":{"status":404,"content":{"mimeType":"text/html"}}},{"startedDateTime":"2024-03-01T10:00:00.000Z","time":12.5,"request":{"method":"GET","url":"https://e.example/a"},"response":{"status":200,"content":{"mimeType":"application/json","size":10}}}]}}'),
        ],
    ),
    'lit_http_metrics': (
        'id bigint, requests bigint, failed bigint, bytes bigint, mean_millis double, max_millis double',
        [
            (1, 2, 1, 10, 12.5, 12.5),
        ],
    ),
    'lit_response_budget': (
        'page_id bigint, host string, used bigint, fits boolean',
        [
            (2, 'h', 10, True),
            (1, 'h', 10, True),
            (0, 'h', 0, True),
            (3, 'h', 40, False),
            (5, 'k', 90, False),
            (4, 'k', 40, False),
        ],
    ),
    'lit_paced_requests': (
        'host string, n bigint, slots bigint, last double',
        [
            ('h', 5, 5, 6.0),
            ('k', 1, 1, 0.0),
        ],
    ),
    'lit_local_places': (
        'url string, place string',
        [
            ('https://E.example/a/b c.png?x=1', 'assets/e.example/b-c-a761689b3fd2.png'),
            ('https://e.example/', 'assets/e.example/index-c9246d2616ac'),
        ],
    ),
    'lit_enum_values': (
        'id bigint, value string',
        [
            (1, 'Success'),
            (2, 'Failed'),
            (3, 'Unknown'),
            (4, 'Unknown'),
        ],
    ),
    'lit_sign_on_handoffs': (
        'page_id bigint, form_ix int, kind string, method string, action string, field_names string, authorization_code_present boolean, state_present boolean, error string',
        [
            (1, 2, 'saml', 'POST', 'https://sso.example/acs', 'SAMLResponse', False, False, ''),
            (2, 0, 'oauth', 'POST', 'https://rp.example/cb?token=<redacted>', 'code|state', True, True, ''),
            (2, 1, 'oauth', 'GET', 'https://shop.example/err', 'error|state', False, False, 'denied'),
        ],
    ),
    'lit_table_values': (
        'page_id bigint, table_ix int, row_ix int, column string, value string, type string',
        [
            (1, 0, 0, 'Item', 'Pear', 'string'),
            (1, 0, 0, 'Cost', '2', 'bigint'),
            (1, 0, 1, 'Item', 'Pear', 'string'),
            (1, 0, 1, 'Cost', '3', 'bigint'),
            (1, 0, 2, 'Item', 'Sum', 'string'),
            (1, 0, 2, 'Cost', '5', 'bigint'),
            (1, 1, 0, 'Column1', '1', 'bigint'),
            (1, 1, 0, 'Column2', 'x', 'string'),
            (1, 1, 0, 'Column3', 'x', 'string'),
            (1, 1, 1, 'Column1', '2', 'bigint'),
            (1, 1, 1, 'Column2', 'true', 'string'),
            (1, 1, 1, 'Column3', '2024-01-02', 'string'),
            (1, 2, 0, 'Name', 'a', 'string'),
            (1, 2, 0, 'Name1', 'b', 'string'),
            (1, 2, 0, 'Column3', 'c', 'string'),
        ],
    ),
    'lit_static_rendered': (
        'level int, title string, change string',
        [
            (2, 'B', 'removed'),
            (2, 'New', 'added'),
        ],
    ),
    'lit_excluded_elements': (
        'page_id bigint, html string',
        [
            (1, '<p>keep</p>'),
        ],
    ),
}
