"""Word lists and patterns of query understanding and ranking.

Fixed values: results depend on them, so they are stated as they have to be, in natural order.
"""

# Phrases that anchor a technical reading of a query.
TECHNICAL_PHRASES = ('input normalization', 'normalize input', 'normalized input', 'clean input', 'preprocess input', 'sanitize input',
 'transform input', 'prepare input', 'trim input', 'standardize data', 'jwt expiration validation', 'jwt expiration',
 'parameterized database query', 'database connection', 'connection pool', 'browser form values', 'api request payload',
 'request payload', 'refresh token', 'feature flag', 'duplicate rows', 'duplicate records', 'duplicate tags',
 'raw json', 'main function', 'form fields', 'unit tests', 'error response', 'error body', 'payload keys cleaned',
 'exponential backoff')

# Words for languages.
LANGUAGE_TERMS = {'python': 'python',
 'java': 'java',
 'javascript': 'javascript',
 'js': 'javascript',
 'typescript': 'typescript',
 'ts': 'typescript',
 'go': 'go',
 'rust': 'rust',
 'sql': 'sql'}

# What speaks for and against each intent of a query.
INTENTS = {'data_preprocessing': {'for': ('preprocess', 'preprocessing', 'preprocessed', 'normalize', 'normalization',
                                'normalized', 'clean', 'cleaned', 'sanitize', 'prepare', 'transform', 'trim', 'trimmed',
                                'standardize', 'coerce'),
                        'against': ('assertion', 'test', 'testing', 'sql', 'transaction', 'endpoint'),
                        'phrases': ('input normalization', 'normalize input', 'normalized input', 'clean input',
                                    'preprocess input', 'sanitize input', 'transform input', 'prepare input',
                                    'trim input', 'standardize data', 'form fields', 'duplicate tags',
                                    'payload keys cleaned')},
 'function_behavior': {'for': ('function', 'method', 'helper', 'routine', 'behavior', 'calculate', 'return', 'returns',
                               'does', 'handle', 'parser'),
                       'against': ('test', 'testing', 'assertion', 'configuration', 'database', 'sql'),
                       'phrases': ('function behavior', 'raw json', 'entry point'),
                       'patterns': ('\\b[a-zA-Z_$][a-zA-Z0-9_$]*\\([^)]*\\)',)},
 'authentication': {'for': ('auth', 'authenticate', 'authenticated', 'authentication', 'authorization', 'authorize',
                            'jwt', 'token', 'bearer', 'login', 'permission', 'credential', 'session', 'refresh',
                            'expiration', 'expired'),
                    'against': ('database', 'sql', 'yaml', 'testing'),
                    'phrases': ('jwt expiration validation', 'jwt expiration', 'refresh token', 'access token',
                                'bearer token', 'session token'),
                    'patterns': ('\\b(?:JWT|OAuth|SAML|Auth[A-Za-z0-9_$]*)\\b',)},
 'database': {'for': ('database', 'db', 'sql', 'query', 'queries', 'insert', 'select', 'transaction', 'connection',
                      'connections', 'pool', 'jdbc', 'orm', 'postgres', 'mysql', 'datasource', 'rows', 'fetched',
                      'retry', 'retries'),
              'against': ('frontend', 'browser', 'component', 'jwt'),
              'phrases': ('parameterized database query', 'database connection', 'connection pool', 'bulk insert',
                          'rows fetched', 'database retry'),
              'patterns': ('\\b(?:DB|DB_URL|JDBC|ORM|Postgres|MySQL)[A-Za-z0-9_$]*\\b',)},
 'api': {'for': ('api', 'endpoint', 'request', 'response', 'payload', 'http', 'route', 'rest', 'graphql', 'serialize',
                 'serialized', 'controller'),
         'against': ('database', 'sql', 'yaml', 'unit', 'error', 'exception', 'failure'),
         'phrases': ('api request payload', 'request payload', 'request fields', 'json headers', 'api call',
                     'http endpoint', 'error response', 'error body'),
         'patterns': ('\\b(?:API|HTTP|REST|GraphQL|[A-Z]+_URL)\\b',)},
 'error_handling': {'for': ('error', 'errors', 'exception', 'exceptions', 'failure', 'failed', 'fallback', 'recovery',
                            'timeout', 'handling', 'log', 'logging', 'retry', 'retries'),
                    'against': ('success', 'configuration', 'component'),
                    'phrases': ('error response', 'error body', 'api error body', 'bad request', 'bad-request',
                                'bad request payload', 'bad-request payload', 'unknown exception', 'request exceptions',
                                'exponential backoff', 'retry after failure')},
 'configuration': {'for': ('config', 'configuration', 'setting', 'settings', 'environment', 'env', 'yaml', 'json',
                           'constant', 'constants', 'datasource'),
                   'against': ('assertion', 'unit', 'component'),
                   'phrases': ('feature flag', 'environment configuration', 'default timeout', 'retry constants'),
                   'patterns': ('\\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\\b', '\\b(?:DB_URL|API_BASE_URL|DEBUG)\\b')},
 'algorithm': {'for': ('algorithm', 'sort', 'sorted', 'search', 'hash', 'graph', 'rank', 'ranking', 'score', 'unique',
                       'map', 'deduplicate', 'deduplication', 'duplicate', 'distinct', 'descending'),
               'against': ('jwt', 'authentication', 'yaml'),
               'phrases': ('duplicate rows', 'duplicate records', 'unique by identifier', 'descending order',
                           'exponential backoff')},
 'ui_frontend': {'for': ('ui', 'frontend', 'component', 'react', 'browser', 'render', 'renders', 'button', 'form',
                         'view', 'dom', 'javascript'),
                 'against': ('database', 'sql', 'server-side'),
                 'phrases': ('browser form values', 'frontend environment configuration', 'list item', 'form fields')},
 'backend': {'for': ('backend', 'server', 'server-side', 'service', 'worker', 'controller', 'repository', 'dispatch',
                     'entry'),
             'against': ('browser', 'frontend', 'component'),
             'phrases': ('backend service', 'server-side', 'entry point', 'dispatch payload')},
 'testing': {'for': ('test', 'tests', 'testing', 'mock', 'fixture', 'assert', 'assertion', 'coverage', 'expects',
                     'verified', 'verify', 'unit'),
             'against': ('production', 'runtime'),
             'phrases': ('unit tests', 'verified with an assertion', 'test expects', 'assertion',
                         'test preprocessing')},
 'performance': {'for': ('performance', 'fast', 'latency', 'optimize', 'benchmark', 'cache', 'memory', 'backoff',
                         'efficient', 'recompute'),
                 'against': ('assertion', 'frontend'),
                 'phrases': ('exponential backoff', 'before recomputing', 'connection pool')},
 'general_code_search': {}}

# Words that say little by themselves.
AMBIGUOUS_TERMS = ['normalization', 'normalize', 'normalized', 'duplicate', 'duplicates', 'payload', 'retry', 'request', 'function',
 'parse', 'parser', 'validation', 'processing']

# Words that name nothing in particular in code.
GENERIC_IDENTIFIERS = ['api', 'code', 'data', 'function', 'handler', 'manager', 'method', 'normalization', 'normalize', 'payload', 'request',
 'response', 'service', 'value', 'values', 'class', 'module', 'helper', 'implementation', 'where', 'which', 'how',
 'what', 'when', 'why']

# Words in a candidate that support an intent.
INTENT_SUPPORT = {'data_preprocessing': ['preprocess', 'preprocessing', 'normalize', 'normalized', 'clean', 'sanitize', 'transform',
                        'trim', 'standardize', 'input', 'form', 'payload', 'field', 'fields', 'tags'],
 'authentication': ['auth', 'authenticate', 'authentication', 'authorization', 'authorize', 'jwt', 'token', 'bearer',
                    'login', 'permission', 'credential', 'session', 'refresh', 'expiration', 'expired'],
 'database': ['database', 'db', 'sql', 'query', 'insert', 'select', 'transaction', 'connection', 'jdbc', 'orm',
              'postgres', 'mysql', 'datasource', 'repository', 'rows'],
 'api': ['api', 'endpoint', 'request', 'response', 'payload', 'http', 'route', 'rest', 'graphql', 'serialize',
         'controller'],
 'error_handling': ['error', 'exception', 'failure', 'failed', 'fallback', 'recovery', 'timeout', 'retry', 'retries'],
 'configuration': ['config', 'configuration', 'setting', 'settings', 'environment', 'env', 'yaml', 'json', 'constant',
                   'constants', 'datasource'],
 'algorithm': ['algorithm', 'sort', 'sorted', 'search', 'hash', 'graph', 'rank', 'ranking', 'score', 'unique', 'map',
               'deduplicate', 'duplicate', 'distinct'],
 'ui_frontend': ['ui', 'frontend', 'component', 'react', 'browser', 'render', 'button', 'form', 'view', 'dom', 'web'],
 'backend': ['backend', 'server', 'service', 'worker', 'controller', 'repository', 'dispatch', 'entry'],
 'testing': ['test', 'tests', 'testing', 'mock', 'fixture', 'assert', 'assertion', 'coverage', 'expects', 'verify',
             'unit'],
 'performance': ['performance', 'fast', 'latency', 'optimize', 'benchmark', 'cache', 'memory', 'backoff', 'efficient',
                 'recompute']}

# Languages by file suffix.
SUFFIX_LANGUAGE = {'.py': 'python',
 '.java': 'java',
 '.js': 'javascript',
 '.jsx': 'javascript',
 '.ts': 'typescript',
 '.tsx': 'typescript',
 '.go': 'go',
 '.rs': 'rust',
 '.rb': 'ruby',
 '.cpp': 'cpp',
 '.c': 'c',
 '.h': 'c',
 '.cs': 'csharp',
 '.json': 'json',
 '.yaml': 'yaml',
 '.yml': 'yaml',
 '.sql': 'sql'}

# Words of a preprocessing query.
PREPROCESSING_TERMS = ('preprocess', 'preprocessing', 'preprocessed', 'normalize', 'normalization', 'normalized', 'clean', 'cleaned',
 'sanitize', 'prepare', 'transform', 'trim', 'trimmed', 'standardize')

# Words left out of lexical queries.
STOPWORDS = ['a', 'an', 'and', 'are', 'as', 'at', 'be', 'before', 'by', 'for', 'from', 'how', 'in', 'is', 'it', 'of', 'on', 'or',
 'the', 'to', 'was', 'were', 'which', 'where', 'with', 'this', 'that', 'does', 'do', 'did', 'then', 'into', 'than',
 'via', 'who']

# What the expansion rules look at.
CONTEXT = {
    'preprocessing': ['input', 'data', 'field', 'fields', 'form', 'forms', 'payload', 'value', 'values', 'record', 'records',
        'row', 'rows', 'text', 'string', 'request', 'keys', 'tags'],
    'testing': ['test', 'tests', 'testing', 'assert', 'assertion', 'unit', 'fixture', 'mock'],
    'auth': ['jwt', 'bearer', 'authentication', 'authorization', 'authenticate', 'login', 'credential', 'session'],
    'token_use': ['validate', 'validation', 'expire', 'expiration', 'refresh', 'access'],
    'database': ['database', 'db', 'sql', 'jdbc', 'orm', 'datasource', 'transaction'],
    'pool': ['connection', 'pool'],
    'statement': ['insert', 'select'],
    'duplicates': ['duplicate', 'duplicates', 'deduplicate', 'deduplication', 'unique', 'distinct'],
    'error': ['error', 'errors', 'exception', 'exceptions', 'failure', 'failures', 'failed'],
    'recovery': ['fallback', 'recovery'],
    'retried': ['network', 'request', 'connection', 'database'],
    'api': ['api', 'endpoint', 'http', 'rest', 'graphql', 'route', 'payload', 'response', 'request'],
    'not_api': ['jwt', 'token', 'bearer', 'authentication', 'authorization', 'session', 'test', 'tests', 'testing', 'assert',
        'assertion', 'unit', 'fixture', 'mock', 'preprocess', 'preprocessing', 'normalize', 'normalization', 'normalized',
        'clean', 'cleaned', 'sanitize', 'transform', 'trim', 'standardize', 'database', 'db', 'sql', 'transaction',
        'connection', 'query'],
}

# Phrases of a preprocessing query.
PREPROCESSING_PHRASES = [
    'input normalization', 'normalize input', 'normalized input', 'clean input', 'preprocess input', 'sanitize input',
    'transform input', 'prepare input', 'trim input', 'standardize data', 'form fields', 'duplicate tags',
]
